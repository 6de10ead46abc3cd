import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tallyforge.operators import arithmetic, tools, toolworld


def said(name, /, **args):
    return tools.call(name, tools.STATELESS, {}, args)


@pytest.mark.parametrize(
    ("name", "args", "want"),
    [
        ("get_weather", {"city": "Tokyo", "units": "fahrenheit"}, {"city": "Tokyo", "temperature": 71.6, "units": "fahrenheit", "condition": "sunny", "humidity": 60}),
        ("get_weather", {"city": "Oslo"}, {"city": "Oslo", "temperature": 20.0, "units": "celsius", "condition": "clear", "humidity": 50}),
        ("get_calendar_events", {"date": "2026-06-09"}, []),
        ("create_event", {"title": "t", "date": "d", "time": "09:00"}, {"event_id": "evt_001", "status": "created", "title": "t", "date": "d", "time": "09:00", "attendees": [], "reminder": None}),
        ("get_stock_price", {"symbol": "aapl"}, {"symbol": "AAPL", "price": 187.32, "currency": "USD", "change_percent": 0.42}),
        ("send_message", {"recipient": "a@b", "message": "m"}, {"status": "sent", "message_id": "msg_001", "recipient": "a@b"}),
        ("write_file", {"path": "/x", "content": "abc"}, {"status": "ok", "path": "/x", "bytes_written": 3}),
        ("read_file", {"path": "/none"}, {"error": "file not found: /none"}),
        ("read_file", {"path": "/data/numbers.txt"}, {"path": "/data/numbers.txt", "content": "10 20 30 40"}),
        ("create_ticket", {"title": "t"}, {"ticket_id": "TCK-2026", "status": "open", "title": "t", "fields": {}}),
        ("run_deploy", {"service": "s", "env": "prod", "dry_run": True}, {"service": "s", "env": "prod", "replicas": 1, "tags": [], "dry_run": True, "config": {}, "status": "validated"}),
        ("post_update", {"channel": "#ops", "content": "{x} $y"}, {"status": "posted", "channel": "#ops", "chars": "6"}),
        ("run_command", {"command": "ls {a}"}, {"status": "ok", "ran": "ls {a}"}),
        ("ask_user", {"question": "$q"}, {"status": "asked", "question": "$q"}),
        ("cli_help", {"topic": "x"}, {"error": "no help for 'x'; known topics: deployer, notes, ticket"}),
        ("get_contacts", {"name": "AL"}, [{"name": "Alice", "email": "alice@example.com", "phone": "+1-555-0101", "city": "Lisbon"}]),
        ("nothing", {}, {"error": "unknown tool: nothing"}),
        ("get_weather", {}, {"error": "invalid arguments for get_weather: get_weather() missing 1 required positional argument: 'city'"}),
        ("send_message", {"x": 1}, {"error": "invalid arguments for send_message: send_message() got an unexpected keyword argument 'x'"}),
    ],
)
def test_stateless_tools(name, args, want):
    assert said(name, **args) == want


def test_search_gives_one_to_three_results():
    assert [len(said("search_web", query="{q}", max_results=n)) for n in (-1, 0, 1, 2, 3, 9)] == [1, 1, 1, 2, 3, 3]
    assert said("search_web", query="{q}")[1]["title"] == "{q} explained"


def test_fetched_tickets_and_help_are_whole():
    assert said("fetch_ticket", ticket_id="T1")["reporter"] == "wren@acme.test" and "--vault is REQUIRED" in said("cli_help", topic="notes")["usage"]
    assert len(said("get_contacts")) == 5 and said("get_contacts")[4]["phone"] == "+1-555-0105"


def test_overrides_come_in_order():
    rules = {"kv_set": {"always_fail": True, "first_call_behavior": "empty"}, "kv_get": {"first_call_behavior": "odd"}, "kv_list": {"first_call_behavior": "empty"}, "issue_refund": {"require_args": {"manager_code": " mgr-9"}, "first_call_behavior": "error"}}
    w = toolworld.World({}, rules)
    assert [w.call("kv_set", {"key": "a", "value": 1}) for _ in range(2)] == [{"error": "kv_set is unavailable: the upstream service is down"}] * 2
    assert w.call("kv_get", {"key": "a"}) == {"error": "unknown first_call_behavior: odd"} and w.call("kv_get", {"key": "a"}) == {"key": "a", "value": None}
    assert w.call("kv_list", {}) == [] and w.call("kv_list", {}) == {"keys": []}
    assert "temporary failure" in w.call("issue_refund", {})["error"] and "the 'manager_code' argument" in w.call("issue_refund", {"order_id": 1, "amount": 1})["error"]
    assert w.call("issue_refund", {"order_id": 1, "amount": 60, "manager_code": "MGR-9"})["balance"] == -60


def test_worlds_with_and_without_state():
    full, plain = toolworld.World({"files": {"a": "x\n"}}), toolworld.World(stateful=False)
    assert full.call("read_file", {"path": "b"}) == {"error": "file not found: b", "hint": "call list_files to see what exists"}
    assert plain.call("read_file", {"path": "b"}) == {"error": "file not found: b"} and "unknown tool" in plain.call("kv_list", {})["error"]
    assert full.call("list_files", {"prefix": None}) == {"paths": ["a"], "count": 1} and full.call("get_weather", {"city": "x"})["humidity"] == 50


numbers = st.one_of(st.integers(0, 60).map(str), st.floats(0, 50, allow_nan=False).map(lambda x: f"{x:.3f}"))
sums = st.recursive(numbers, lambda e: st.one_of(st.tuples(e, st.sampled_from(["+", "-", "*", "/", "%", " - ", " * "]), e).map("".join), e.map("({})".format), e.map("-{}".format), st.tuples(e, st.sampled_from(["2", "-1", "0"])).map("**".join)), max_leaves=7)


@settings(max_examples=400, deadline=None)
@given(sums)
def test_arithmetic_is_pythons(text):
    try:
        want = eval(text, {"__builtins__": {}})  # noqa: S307  (made of numbers and signs above)
    except (ZeroDivisionError, OverflowError) as e:
        with pytest.raises(type(e)):
            arithmetic.evaluate(text)
        return
    if not isinstance(want, complex):
        assert arithmetic.evaluate(text) == want


@pytest.mark.parametrize("text", ["", "1 +", "(1", "1)", "a", "1 // 2", "+1", "f(1)", "1 2", "'x'", "1 < 2", "**2"])
def test_arithmetic_refuses_the_rest(text):
    assert set(said("calculate", expression=text)) == {"expression", "error"}


def test_schemas_and_offers(spark):
    rows = {(r["name"], r["stateful"]): json.loads(r["schema"]) for r in toolworld.schemas(spark).collect()}
    assert len(rows) == 31 and rows["get_weather", False]["parameters"]["required"] == ["city"]
    assert rows["kv_set", True]["parameters"]["properties"]["value"] == {"description": "Value to store (any type)."}
    assert rows["db_query", False]["parameters"]["properties"]["order_by"]["enum"] == ["id", "total", "status"]
    tasks = spark.createDataFrame([(1, ["read_file", "get_weather"]), (2, [])], "task_id long, tools array<string>")
    got = {r["task_id"]: json.loads(r["payload"]) for r in toolworld.offered(tasks).collect()}
    assert [x["function"]["name"] for x in got[1]] == ["read_file", "get_weather"] and got[2] == []
    assert got[1][0] == {"type": "function", "function": tools.schema("read_file")} and "full contents" in got[1][0]["function"]["description"]


def test_answers_of_rows(spark):
    calls = spark.createDataFrame([(i, "get_weather", json.dumps({"city": c})) for i, c in enumerate(["Paris", "Paris", "x"])] + [(9, "nothing", None)], "id long, name string, arguments string")
    got = {r["id"]: json.loads(r["answer"]) for r in toolworld.answers(calls).collect()}
    assert got[0] == got[1] and got[0]["humidity"] == 62 and "unknown tool" in got[9]["error"] and len(got) == 4
