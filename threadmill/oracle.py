"""DuckDB oracle texts: the same results written as plain SQL.

The driver registers the raw tables as views; every oracle starts from them.
Shared pieces (fixture views, dictionaries) are CTE snippets composed here.
"""

from __future__ import annotations

from threadmill.functions import emoji as E
from threadmill.functions import patterns as P

POSTS = """posts AS (
SELECT doc_id AS id, doc_id % 37 AS author_id, doc_id - doc_id % 5 AS conversation_id,
       CAST('2024-01-01 00:00:00' AS TIMESTAMP) + INTERVAL '1' MINUTE * (doc_id * 37 % 10007) AS created_at,
       lang,
       CASE doc_id % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'CA' WHEN 2 THEN 'MX' ELSE 'GB' END AS country,
       CAST(doc_id * 7 % 360 - 180 AS DOUBLE) AS lon, CAST(doc_id * 13 % 180 - 90 AS DOUBLE) AS lat,
       CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 11 END AS retweet_count,
       CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 5 END AS reply_count,
       CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 17 END AS like_count,
       CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 2 END AS quote_count,
       concat(CASE WHEN n_chars % 7 = 0 THEN 'RT ' ELSE '' END,
              CASE WHEN n_chars % 3 = 0 THEN concat('@', lang, '_', CAST(n_chars % 11 AS VARCHAR(20)), ' ') ELSE '' END,
              text,
              CASE WHEN n_chars % 2 = 0 THEN concat(' #topic', CAST(n_chars % 9 AS VARCHAR(20))) ELSE '' END,
              CASE WHEN n_chars % 5 = 0 THEN concat(' https://www.ex', CAST(n_chars % 13 AS VARCHAR(20)), '.com/p?q=', CAST(doc_id AS VARCHAR(20))) ELSE '' END,
              CASE n_chars % 4 WHEN 0 THEN ' :)' WHEN 1 THEN ' ;)' WHEN 2 THEN ' :p' ELSE '' END) AS text
FROM documents)"""

TOPICS = """topics AS (
SELECT d.doc_id AS id, d.text AS x, concat('about ', d.source) AS topic,
       CASE WHEN l.toxic = 1 THEN 'Argument_against' WHEN l.quality = 1 THEN 'Argument_for' ELSE 'NoArgument' END AS y,
       CASE WHEN d.doc_id % 10 < 8 THEN 'train' WHEN d.doc_id % 10 = 8 THEN 'test' ELSE 'val' END AS split
FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""

LABEL_SHEET = """label_sheet AS (
SELECT d.doc_id AS id, d.text AS text,
       CASE WHEN d.doc_id % 9 = 8 THEN NULL
            WHEN l.quality = 1 THEN CASE d.doc_id % 4 WHEN 0 THEN 'Y' WHEN 1 THEN 'yes' WHEN 2 THEN 'TRUE' ELSE 't' END
            ELSE CASE d.doc_id % 4 WHEN 0 THEN 'n' WHEN 1 THEN 'No' WHEN 2 THEN 'False' ELSE 'F' END END AS claim
FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""

USERS = """users AS (
SELECT DISTINCT author_id AS id, concat('user_', CAST(author_id AS VARCHAR)) AS username FROM posts)"""

COMPLETED = """completed AS (
SELECT DISTINCT conversation_id FROM posts WHERE conversation_id % 3 = 0)"""

EXTERNAL_LABELS = """external_labels AS (
SELECT CAST(doc_id AS VARCHAR) AS tweet_id, CAST(quality AS VARCHAR) AS claim, toxic FROM labels)"""


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def h60(expr: str, seed) -> str:
    """DuckDB form of functions.hashing.hash60 over one string expression."""
    return f"('0x' || substr(md5(concat_ws(':', {expr}, {q(str(seed))})), 1, 15))::BIGINT"


def url_re() -> str:
    return q(P.URL_PATTERN_RE2)


def mask_text_sql(col: str) -> str:
    """C2-C6 in DuckDB."""
    lowered = f"lower({col})"
    urls = f"regexp_replace({lowered}, {url_re()}, '[URL]', 'g')"
    tags = f"regexp_replace({urls}, {q(P.HASHTAG_PATTERN)}, '[TAG] \\1', 'g')"
    rt = f"(CASE WHEN substr(t_, 1, 2) = 'rt' THEN '[RT]' || substr(t_, 3) ELSE t_ END)"
    # inline the retweet rule around the tag step
    rt = rt.replace("t_", f"({tags})")
    men = f"regexp_replace({rt}, {q(P.MENTION_PATTERN)}, '[MEN]', 'g')"
    return men


def _emoticon_list_sql(entries) -> str:
    return "[" + ", ".join(f"{{'k': {q(k)}, 'v': {q(v)}}}" for k, v in entries) + "]"


def replace_emoji_sql(col: str) -> str:
    """C11 in DuckDB: sequential fold over the emoji table, then the emoticons."""
    emo = E.unicode_emoji_entries()
    emo_map = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in emo) + "}"
    cls = "[" + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in E.EMOJI_BLOCKS) + "]"
    bare = f"regexp_replace({col}, {q('(' + cls + ')[' + E.BINDERS + ']+')}, '\\1', 'g')"
    present = f"list_distinct(regexp_extract_all({bare}, {q('(' + cls + ')')}, 1))"
    step1 = (
        f"list_reduce({present}, lambda acc, e: replace(acc, e, coalesce({emo_map}[e], e)), {bare})"
    )
    step2 = f"list_reduce({_emoticon_list_sql(E.emoticon_entries())}, lambda acc, e: replace(acc, e.k, e.v), {step1})"
    return step2


def md5_key(cols: list[str], seed) -> str:
    parts = ", ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"md5(concat_ws(':', {parts}, {q(str(seed))}))"


def map_labels_sql(col: str) -> str:
    s = f"lower(CAST({col} AS VARCHAR))"
    return (f"CAST(CASE WHEN {s} IS NULL THEN NULL WHEN {s} IN ('1', '1.0', 'y', 'yes', 'true', 't') THEN 1 WHEN {s} IN ('0', '0.0', 'n', 'no', 'false', 'f') THEN 0 "
            f"ELSE error(concat('unrecognized claim label ', {s})) END AS INTEGER)")


HYDRATED = """hydrated AS (
SELECT CAST(e.tweet_id AS BIGINT) AS id, e.claim, e.toxic, p.text, p.lang, p.author_id, p.conversation_id
FROM external_labels e LEFT JOIN posts p ON p.id = CAST(e.tweet_id AS BIGINT))"""

UNION_LABELS = """union_labels AS (
SELECT id, text, claim, CAST(NULL AS INTEGER) AS toxic, 'own' AS source FROM label_sheet
UNION ALL SELECT id, text, claim, toxic, 'external' AS source FROM hydrated)"""


def label_chain_ctes(seed=42, with_posts: bool = True, own: str = "label_sheet") -> str:
    """E6-E13 as CTEs ending in ``split_rows``; ``own`` names the table of own labels."""
    bal_key = md5_key(["source", "id"], f"balance:{seed}")
    ord_key = md5_key(["source", "id"], f"order:{seed}")
    head = f"{POSTS}, " if with_posts else ""
    return f"""{head}{LABEL_SHEET + ", " if own == "label_sheet" else ""}{EXTERNAL_LABELS}, {HYDRATED}, {UNION_LABELS.replace("label_sheet", own)},
labelled AS (SELECT * FROM union_labels WHERE claim IS NOT NULL AND text IS NOT NULL),
mapped AS (SELECT id, text, toxic, source, {map_labels_sql('claim')} AS claim FROM labelled),
balanced AS (SELECT * FROM mapped
  QUALIFY row_number() OVER (PARTITION BY claim ORDER BY {bal_key}, source, id)
          <= (SELECT min(n) FROM (SELECT count(*) AS n FROM mapped GROUP BY claim))),
renamed AS (SELECT id, source, toxic, text AS x, claim AS y FROM balanced),
ranked AS (SELECT *, row_number() OVER (ORDER BY {ord_key}, source, id) AS rank FROM renamed),
split_rows AS (SELECT *, CASE WHEN rank <= floor((SELECT count(*) FROM ranked) * 0.8::DOUBLE) THEN 'train'
                              WHEN rank <= floor((SELECT count(*) FROM ranked) * 0.93::DOUBLE) THEN 'test'
                              ELSE 'val' END AS split FROM ranked)"""


# ---- tokens ------------------------------------------------------------------
def pretokenize_sql(col: str, lower=True, strip_accents=True, cjk=False) -> str:
    """Words, punctuation marks and the five specials; each word is normalised on its own."""
    punct = r"\p{P}$+<=>^`|~"
    t = f"regexp_replace({col}, '[^\\P{{C}}\\t\\n\\r]|\\x{{FFFD}}', '', 'g')"
    t = f"regexp_replace({t}, '[\\t\\n\\r\\p{{Z}}]', ' ', 'g')"
    if cjk:
        ranges = [(0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F)]
        cls = "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in ranges)
        t = f"regexp_replace({t}, '([{cls}])', ' \\1 ', 'g')"
    found = f"regexp_extract_all({t}, '\\[(?:PAD|UNK|CLS|SEP|MASK)\\]|[^\\s{punct}]+|[{punct}]')"
    word = "w"
    if lower:
        word = f"lower({word})"
    if strip_accents:
        word = f"strip_accents({word})"
    if word == "w":
        return found
    return f"list_transform({found}, lambda w: CASE WHEN length(w) > 3 AND starts_with(w, '[') THEN w ELSE {word} END)"


def vocab_ctes(corpus: str, text_col: str, vocab_size=None, min_frequency=None, limit_alphabet=None, lower=False, strip=False) -> str:
    """word_counts_all, alpha, vocab CTEs over the CTE ``corpus``."""
    vocab_size = vocab_size or P.VOCAB_SIZE
    min_frequency = min_frequency or P.MIN_FREQUENCY
    limit_alphabet = limit_alphabet or P.LIMIT_ALPHABET
    n_sp = len(P.SPECIAL_TOKENS)
    specials = ", ".join(f"({q(t)}, {i})" for i, t in enumerate(P.SPECIAL_TOKENS))
    return f"""word_counts_all AS (
  SELECT word, count(*) AS count FROM (SELECT unnest({pretokenize_sql(text_col, lower, strip, False)}) AS word FROM {corpus}) GROUP BY word),
alpha AS (
  SELECT ch, count, CAST(row_number() OVER (ORDER BY count DESC, ch) AS BIGINT) AS rank FROM (
    SELECT ch, CAST(sum(count) AS BIGINT) AS count FROM (SELECT unnest(regexp_extract_all(word, '(?s).')) AS ch, count FROM word_counts_all) GROUP BY ch
    ORDER BY count DESC, ch LIMIT {limit_alphabet})),
vocab_base AS (
  SELECT * FROM (VALUES {specials}) s(token, id)
  UNION ALL SELECT ch, CAST({n_sp} + rank - 1 AS INTEGER) FROM alpha
  UNION ALL SELECT '##' || ch, CAST({n_sp} + (SELECT count(*) FROM alpha) + rank - 1 AS INTEGER) FROM alpha),
vocab_words AS (
  SELECT word, row_number() OVER (ORDER BY count DESC, word) AS rank FROM (
    SELECT word, count FROM word_counts_all WHERE count >= {min_frequency} AND length(word) > 1
      AND word NOT IN (SELECT token FROM vocab_base) ORDER BY count DESC, word LIMIT {vocab_size})),
vocab AS (
  SELECT token, CAST(id AS INTEGER) AS id FROM (
    SELECT token, id FROM vocab_base
    UNION ALL SELECT word, CAST({n_sp} + 2 * (SELECT count(*) FROM alpha) + rank - 1 AS INTEGER) FROM vocab_words)
  WHERE id < {vocab_size})"""


def wordpiece_ctes(words: str, max_chars=None) -> str:
    """wp(word, pieces, piece_ids) for the distinct words of CTE ``words``
    against CTE ``vocab``."""
    max_chars = max_chars or P.MAX_WORD_CHARS
    return f"""wp_longest AS (SELECT max(length(token)) AS l FROM vocab),
wp_starts AS (SELECT word, unnest(range(0, length(word))) AS s FROM (SELECT DISTINCT word FROM {words} WHERE word IS NOT NULL) WHERE length(word) <= {max_chars}),
wp_cand AS (SELECT word, s, e, CASE WHEN s = 0 THEN '' ELSE '##' END || substr(word, s + 1, e - s) AS piece FROM (
  SELECT word, s, unnest(range(s + 1, least(length(word), s + least({max_chars}, (SELECT l FROM wp_longest))) + 1)) AS e FROM wp_starts)),
wp_best AS (SELECT word, s, arg_max({{'e': e, 'piece': piece, 'pid': id}}, e) AS m FROM wp_cand JOIN vocab ON vocab.token = wp_cand.piece GROUP BY word, s),
wp_chain AS (SELECT word, map_from_entries(list({{'key': s, 'value': m}})) AS mp FROM wp_best GROUP BY word),
wp_walk AS (SELECT word, list_reduce(range(length(word)), lambda acc, x:
    CASE WHEN acc.pos >= length(word) OR NOT acc.ok THEN acc
         WHEN mp[acc.pos] IS NULL THEN {{'pos': acc.pos, 'pieces': acc.pieces, 'ids': acc.ids, 'ok': false}}
         ELSE {{'pos': mp[acc.pos].e, 'pieces': list_append(acc.pieces, mp[acc.pos].piece), 'ids': list_append(acc.ids, mp[acc.pos].pid), 'ok': true}} END,
    {{'pos': 0, 'pieces': []::VARCHAR[], 'ids': []::INTEGER[], 'ok': true}}) AS r FROM wp_chain),
wp AS (
  SELECT word, CASE WHEN r.ok THEN r.pieces ELSE ['[UNK]'] END AS pieces, CASE WHEN r.ok THEN r.ids ELSE [1] END AS piece_ids FROM wp_walk
  UNION ALL SELECT DISTINCT word, ['[UNK]'], [1] FROM {words} WHERE word IS NOT NULL AND word NOT IN (SELECT word FROM wp_walk))"""


def tokenize_ctes(name: str, src: str, key_cols: list[str], text_col: str, lower=True, strip_accents=True, cjk=True) -> str:
    """``{name}_words`` (keys, pos, word) and ``{name}`` (keys, tokens, ids)
    after ``wp`` is defined over ``{name}_words``: call in two parts."""
    keys = ", ".join(key_cols)
    pt = pretokenize_sql(text_col, lower, strip_accents, cjk)
    return f"""{name}_pt AS (SELECT {keys}, {pt} AS pt FROM {src}),
{name}_words AS (SELECT {keys}, unnest(pt) AS word, generate_subscripts(pt, 1) AS pos FROM {name}_pt)"""


def tokenize_join_cte(name: str, src: str, key_cols: list[str]) -> str:
    keys = ", ".join(key_cols)
    on = " AND ".join(f"s.{k} IS NOT DISTINCT FROM g.{k}" for k in key_cols)
    skeys = ", ".join(f"s.{k}" for k in key_cols)
    return f"""{name}_g AS (SELECT {keys}, flatten(list(pieces ORDER BY pos)) AS tokens, flatten(list(piece_ids ORDER BY pos)) AS ids
  FROM {name}_words w JOIN wp USING (word) GROUP BY {keys}),
{name} AS (SELECT s.*, coalesce(g.tokens, []::VARCHAR[]) AS tokens, coalesce(g.ids, []::INTEGER[]) AS ids
  FROM {src} s LEFT JOIN {name}_g g ON {on})"""


def repair_sql(tokens: str) -> str:
    j = f"(chr(1) || array_to_string({tokens}, chr(2) || chr(1)) || chr(2))"
    for nm in ["rt", "men", "tag"]:
        j = f"replace({j}, chr(1) || '[' || chr(2) || chr(1) || '{nm}' || chr(2) || chr(1) || ']' || chr(2), chr(1) || '[{nm.upper()}]' || chr(2))"
    return f"(CASE WHEN len({tokens}) = 0 THEN {tokens} ELSE string_split(substr({j}, 2, length({j}) - 2), chr(2) || chr(1)) END)"



# ---- sentences and encoding --------------------------------------------------
def merge_plan_sql(lengths: str, min_length: int) -> str:
    """F3 plan on a list of lengths (DuckDB, 1-based lists)."""
    init = f"list_transform({lengths}, lambda n, i: {{'n': n, 'first': i - 1, 'last': i - 1}})"
    mg = lambda a, b: f"{{'n': ({a}).n + ({b}).n, 'first': ({a}).first, 'last': ({b}).last}}"
    i = "coalesce(list_position(list_transform(arr, lambda z: z.n < " + str(min_length) + "), true), 0)"
    m = "len(arr)"
    body = f"""CASE WHEN {i} = 0 THEN arr
      WHEN {m} = 1 THEN list_slice(arr, 1, 0)
      WHEN {i} > 1 AND {i} < {m} AND arr[{i} - 1].n < arr[{i} + 1].n
        THEN list_concat(list_slice(arr, 1, {i} - 2), [{mg(f'arr[{i} - 1]', f'arr[{i}]')}], list_slice(arr, {i} + 1, {m}))
      WHEN {i} > 1 AND {i} < {m}
        THEN list_concat(list_slice(arr, 1, {i} - 1), [{mg(f'arr[{i}]', f'arr[{i} + 1]')}], list_slice(arr, {i} + 2, {m}))
      WHEN {i} = {m} THEN list_concat(list_slice(arr, 1, {i} - 2), [{mg(f'arr[{i} - 1]', f'arr[{i}]')}])
      ELSE list_concat([{mg(f'arr[{i}]', f'arr[{i} + 1]')}], list_slice(arr, {i} + 2, {m})) END"""
    return f"list_reduce(range(greatest(len({lengths}), 1)), lambda arr, _x: {body}, {init})"


def merged_sentences_sql(sents: str, min_length: int) -> str:
    plan = merge_plan_sql(f"list_transform({sents}, lambda s: len(s))", min_length)
    return f"list_transform({plan}, lambda r: flatten(list_slice({sents}, r.first + 1, r.last + 1)))"


def sents_str(col: str) -> str:
    return f"array_to_string(list_transform({col}, lambda s: array_to_string(s, ' ')), ' | ')"
