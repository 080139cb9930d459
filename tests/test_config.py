from quern.sources.config import listed, load_verdict, merged, secure

TEXT = """
# relays
relays:
  - wss://a.example   # first
  - 'wss://b.example/'

  - "ws://c.example"
other:
  - x
"""


def test_lists():
    assert listed(TEXT, "relays") == ["wss://a.example", "wss://b.example/", "ws://c.example"]
    assert listed(TEXT, "other") == ["x"] and listed(TEXT, "none") == []


def test_merge_keeps_the_first_spelling():
    assert merged(["wss://A/", "ws://c"], ["wss://a", "wss://d"]) == ["wss://A/", "ws://c", "wss://d"]
    assert merged(["wss://A/", "ws://c"], ["wss://d"], replace=True) == ["ws://c", "wss://d"]
    assert secure(["wss://x", "ws://y", "WSS://Z"]) == ["wss://x", "WSS://Z"]


def test_load_verdict():
    assert load_verdict(1_000_000, 1.0) == (30.0, True) and load_verdict(1_000_000, 1.1)[1] is False and load_verdict(0, 1)[1] is False
