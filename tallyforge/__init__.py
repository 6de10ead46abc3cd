"""tallyforge: analytics over language-model evaluation trials, and training-data operators, on Spark DataFrames."""
