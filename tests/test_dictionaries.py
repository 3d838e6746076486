"""Emoji / emoticon dictionaries."""

from threadmill.functions import emoji as E


def test_emoticon_entries_first_position_last_value():
    ents = E.emoticon_entries()
    keys = [k for k, _ in ents]
    d = dict(ents)
    assert len(ents) == 138
    assert d[":‑("] == "crying face"          # U+2011 form: sad first, crying last
    assert keys.index(":‑(") < keys.index(":(")  # keeps its first (sad group) position
    assert d["=3"] == "cat face"
    assert d[";3"] == "evil face"
    assert d[":("] == "sad face"
    assert "X3  >:3" in d and ":-)" not in d


def test_emoji_table_by_rule():
    ents = E.unicode_emoji_entries()
    d = dict(ents)
    assert d["\U0001F600"] == " grinning face "
    assert all(len(k) == 1 and v.startswith(" ") and v.endswith(" ") for k, v in ents)


def test_dictionary_tables(spark):
    emo = E.emoji_dictionary(spark)
    assert emo.count() == len(E.unicode_emoji_entries())
    merged = {r["k"]: (r["ord"], r["v"]) for r in E.emoticon_dictionary(spark).collect()}
    assert merged[":‑("][1] == "crying face"
    assert merged[":)"][1] == "happy face"
    assert len(merged) == len(E.unicode_emoji_entries()) + 138
