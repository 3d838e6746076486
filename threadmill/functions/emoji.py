"""Emoji and emoticon dictionaries, and the ordered replacement of C11."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must match the reference) ---------------------------------
# ASCII emoticon groups in their original order. The '‑' inside many entries
# is U+2011 NON-BREAKING HYPHEN, not the ASCII '-'. 'X3  >:3' is one entry.
EMOTICON_GROUPS = [
    ([':‑)', ':)', ':-]', ':]', ':->', ':>', '8-)', '8)', ':-}', ':}', ':o)', ':c)', ':^)', '=]', '=)'], "happy face"),
    ([':‑D', ':D', '8‑D', '8D', '=D', '=3', 'B^D', 'c:', 'C:', ':-))'], "big grin face"),
    (['x‑D', 'xD', 'X‑D', 'XD'], "laughing face"),
    ([':‑(', ':(', ':‑c', ':c', ':‑<', ':<', ':‑[', ':[', ':-||', '>:[', ':{', ':@', ':(', ';('], "sad face"),
    ([':‑(', ":'‑(", ":'(", ':=('], "crying face"),
    ([":'‑)", ":')", ':"D'], "happy tears face"),
    (["D‑':", 'D:<', 'D:', 'D8', 'D;', 'D=', 'DX'], "great dismay face"),
    ([':‑O', ':O', ':‑o', ':o', ':-0', '8‑0', '>:O', '=O', '=o', '=0'], "suprose face"),
    ([':-3', ':3', '=3', 'x3', 'X3  >:3'], "cat face"),
    ([':-*', ':*', ':×'], "kiss face"),
    (['‑)', ';)', '*-)', '*)', ';‑]', ';]', ';^)', ';>', ':‑,', ';D', ';3'], "wink face"),
    ([':‑P', ':P', 'X‑P', 'XP', 'x‑p', 'xp', ':‑p', ':p', ':‑Þ', ':Þ', ':‑þ', ':þ', ':‑b', ':b', 'd:', '=p', '>:P'], "tongue face"),
    ([':-/', ':/', ':‑.', '>:\\', '>:/', ':\\', '=/', '=\\', ':L', '=L', ':S'], "skeptical face"),
    ([':‑|', ':|'], "straight face"),
    ([':$', '://)', '://3'], "embarrased face"),
    ([':‑X', ':X', ':‑#', ':#', ':‑&', ':&'], "sealed lips face"),
    (['O:‑)', 'O:)', '0:‑3', '0:3', '0:‑)', '0:)', '0;^)'], "angel face"),
    (['>:‑)', '>:)', '}:‑)', '}:)', '3:‑)', '3:)', '>;‑)', '>;)', '>:3', ';3'], "evil face"),
]
# ------------------------------------------------------------------------------

# Unicode's emoji characters (property Emoji without the ASCII digits, '#' and
# '*'), as ranges of code points. The package the reference used is not
# available; a character's description is its Unicode name.
EMOJI_RANGES = """
A9 AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 23F8-23FA 24C2 25AA-25AB 25B6 25C0
25FB-25FE 2600-2604 260E 2611 2614-2615 2618 261D 2620 2622-2623 2626 262A 262E-262F 2638-263A 2640 2642 2648-2653
265F-2660 2663 2665-2666 2668 267B 267E-267F 2692-2697 2699 269B-269C 26A0-26A1 26A7 26AA-26AB 26B0-26B1 26BD-26BE
26C4-26C5 26C8 26CE-26CF 26D1 26D3-26D4 26E9-26EA 26F0-26F5 26F7-26FA 26FD 2702 2705 2708-270D 270F 2712 2714 2716
271D 2721 2728 2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2764 2795-2797 27A1 27B0 27BF 2934-2935 2B05-2B07
2B1B-2B1C 2B50 2B55 3030 303D 3297 3299 1F004 1F0CF 1F170-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F1E6-1F1FF
1F201-1F202 1F21A 1F22F 1F232-1F23A 1F250-1F251 1F300-1F321 1F324-1F393 1F396-1F397 1F399-1F39B 1F39E-1F3F0
1F3F3-1F3F5 1F3F7-1F4FD 1F4FF-1F53D 1F549-1F54E 1F550-1F567 1F56F-1F570 1F573-1F57A 1F587 1F58A-1F58D 1F590
1F595-1F596 1F5A4-1F5A5 1F5A8 1F5B1-1F5B2 1F5BC 1F5C2-1F5C4 1F5D1-1F5D3 1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF 1F5F3
1F5FA-1F64F 1F680-1F6C5 1F6CB-1F6D2 1F6D5-1F6D7 1F6DC-1F6E5 1F6E9 1F6EB-1F6EC 1F6F0 1F6F3-1F6FC 1F7E0-1F7EB 1F7F0
1F90C-1F93A 1F93C-1F945 1F947-1F9FF 1FA70-1FA7C 1FA80-1FA89 1FA8F-1FAC6 1FACE-1FADC 1FADF-1FAE9 1FAF0-1FAF8
"""
EMOJI_BLOCKS = [tuple(int(x, 16) for x in (r.split("-") * 2)[:2]) for r in EMOJI_RANGES.split()]
NEAR_EMOJI = "[\\x{A9}\\x{AE}\\x{203C}-\\x{3299}\\x{1F000}-\\x{1FAFF}]"
# What binds emoji into one sign: the joiner, the presentation mark, the key-cap mark.
BINDERS = "\\x{200D}\\x{FE0F}\\x{20E3}"


def emoticon_entries() -> list[tuple[str, str]]:
    """Groups flattened in order with dict semantics: first position, last value."""
    out: dict[str, str] = {}
    for faces, desc in EMOTICON_GROUPS:
        for face in faces:
            out[face] = desc
    return list(out.items())


def describe_emoji_name(name: str) -> str:
    """':grinning_face:' style name -> ' grinning face '."""
    return name.replace("_", " ").replace(":", " ").lower()


@lru_cache(maxsize=1)
def unicode_emoji_entries() -> list[tuple[str, str]]:
    out = []
    for lo, hi in EMOJI_BLOCKS:
        for cp in range(lo, hi + 1):
            ch = chr(cp)
            name = unicodedata.name(ch, None)
            if name:
                out.append((ch, describe_emoji_name(":" + name.replace(" ", "_") + ":")))
    return out


def emoji_dictionary(spark, entries=None):
    """Dictionary table (ord, k, v) of Unicode emoji."""
    entries = entries if entries is not None else unicode_emoji_entries()
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(entries)], "ord int, k string, v string")


def emoticon_dictionary(spark, emoji_entries=None):
    """The emoticon groups exploded with ordinals, merged after C9.

    Per key the first position and the last value win; keys already in the
    emoji table keep their position there and take the emoticon value.
    """
    rows = []
    pos = 0
    for g, (faces, desc) in enumerate(EMOTICON_GROUPS):
        for face in faces:
            rows.append((pos, face, desc))
            pos += 1
    faces = spark.createDataFrame(rows, "ord int, k string, v string")
    flat = faces.groupBy("k").agg(F.min("ord").alias("ord"), F.max_by("v", "ord").alias("v"))
    emo = emoji_dictionary(spark, emoji_entries)
    offset = F.lit(len(emoji_entries if emoji_entries is not None else unicode_emoji_entries()))
    merged = (
        emo.join(flat.withColumnRenamed("v", "v2").withColumnRenamed("ord", "ord2"), "k", "full_outer")
        .select(
            "k",
            F.coalesce(F.col("ord"), F.col("ord2") + offset).alias("ord"),
            F.coalesce(F.col("v2"), F.col("v")).alias("v"),
        )
    )
    return merged


def sql_str(v: str) -> str:
    """Spark SQL string literal."""
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def emoji_char_class() -> str:
    return "[" + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in EMOJI_BLOCKS) + "]"


def telling_chars(emoticons) -> set[str]:
    """Characters of the emoticons that no description holds: a replacement never makes one, so an
    emoticon whose telling characters are not all in a text cannot come up in it at any step."""
    return {c for k, _ in emoticons for c in k} - {c for _, v in emoticons for c in v}


def emoticon_marks(column: str, emoticons=None) -> Column:
    """The telling characters of a text: short, so that asking it is cheap."""
    chars = telling_chars(emoticons if emoticons is not None else emoticon_entries())
    if not chars:
        return F.lit("")
    return F.regexp_replace(F.col(column), "[^" + "".join(f"\\x{{{ord(c):X}}}" for c in sorted(chars)) + "]+", "")


def replace_emoji_sql(text_sql: str, emoji_entries=None, emoticons=None, marks_sql: str | None = None) -> str:
    """Spark SQL text of C11 over the SQL expression ``text_sql``.

    Without ``emoji_entries`` the Unicode characters are described: marks that
    bind emoji into a sequence (a flag, a family, a skin tone) go, and each
    part becomes its description. Keys are then single characters and values
    ASCII, so they commute, and only the emoji present in a row are looked up.

    ``emoji_entries`` is a user's dictionary, (key, description) in order; keys
    may be of any length. A text that holds the first character of any key
    gets one literal replace per entry, in order, each feeding the next.
    The emoticons follow in the same way; with ``marks_sql`` (``emoticon_marks`` of the text after the emoji) only those whose
    telling characters are there are looked for.
    """
    emoticons = emoticons if emoticons is not None else emoticon_entries()
    if emoji_entries is None:
        entries = unicode_emoji_entries()
        keys = ", ".join(sql_str(k) for k, _ in entries)
        vals = ", ".join(sql_str(v) for _, v in entries)
        emo_map = f"map_from_arrays(array({keys}), array({vals}))"
        bare = f"regexp_replace({text_sql}, {sql_str('(' + emoji_char_class() + ')[' + BINDERS + ']+')}, '$1')"
        present = f"array_distinct(regexp_extract_all({bare}, {sql_str('(' + emoji_char_class() + ')')}, 1))"
        full = f"aggregate({present}, {bare}, (acc, e) -> replace(acc, e, coalesce(element_at({emo_map}, e), e)))"
        # four wide ranges hold all emoji and few letters: the exact class, a hundred ranges long, only sees texts that meet them
        out = f"if({text_sql} rlike {sql_str(NEAR_EMOJI)}, {full}, {text_sql})"
    elif emoji_entries:
        firsts = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in sorted({k[0] for k, _ in emoji_entries if k})) + "]"
        pairs = ", ".join(f"struct({sql_str(k)} as k, {sql_str(v)} as v)" for k, v in emoji_entries if k)
        out = f"if({text_sql} rlike {sql_str(firsts)}, aggregate(array({pairs}), {text_sql}, (acc, e) -> replace(acc, e.k, e.v)), {text_sql})"
    else:
        out = text_sql
    # The emoticons, in order, as nested literal replaces: compiled by
    # whole-stage codegen (a lambda fold would be interpreted per element).
    telling = telling_chars(emoticons) if marks_sql else set()
    for k, v in emoticons:
        asked = " and ".join(f"contains({marks_sql}, {sql_str(c)})" for c in sorted(set(k) & telling, reverse=True))
        # replacing the empty string changes nothing and reads nothing
        key = f"if({asked}, {sql_str(k)}, '')" if asked else sql_str(k)
        out = f"replace({out}, {key}, {sql_str(v)})"
    return out


def replace_emoji(column: str, emoji_entries=None, emoticons=None, marks: str | None = None) -> Column:
    """C11 on the named column (``marks``: the column of its ``emoticon_marks``). ``emoji_entries``: list of (key, description),
    or a table (ord, k, v) of dictionary size, read in the order of ``ord``."""
    if emoji_entries is not None and hasattr(emoji_entries, "orderBy"):
        emoji_entries = [(r["k"], r["v"]) for r in emoji_entries.orderBy("ord").collect()]
    return F.expr(replace_emoji_sql(f"`{column}`", emoji_entries, emoticons, f"`{marks}`" if marks else None))
