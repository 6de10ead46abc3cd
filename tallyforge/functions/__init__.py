"""Part of tallyforge."""
