"""Registered queries: sentences, pairs and encoded samples.

The SQL-checked chain runs on the topic corpus with basic tokens and a topic
vocabulary (the encoding operators do not depend on how tokens were made);
the full wordpiece encoders are registered on top.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from threadmill import oracle as O
from threadmill.functions import tokens as T
from threadmill.operators import clean as C
from threadmill.operators import encode as X
from threadmill.operators import labels as L
from threadmill.operators import sentences as S
from threadmill.operators import vocab as D
from threadmill.plans import encoders as EN
from threadmill.plans.catalog import register
from threadmill.session import materialize, written
from threadmill.plans.q_labels import split_table
from threadmill.plans.q_vocab import cleaned, posts_vocab
from threadmill.sources import views as V

SEED = 42
DELIMS = [".", ";", ","]
MIN_LEN = 10


def js(c):
    return F.array_join(F.col(c).cast("array<string>"), " ").alias(c)


def topic_vocab(spark, sf):
    # the alphabet and the words both read the counts
    return materialize(D.vocab_by_frequency(materialize(D.word_counts(V.topics(spark, sf), "x", lower=True, strip_accents=True))))


def topic_docs(spark, sf):
    """Documents with packed sentences (``S.pack``)."""
    # together by id before they are split: one shuffle, of the texts, and none of pieces or tokens
    pieces = S.split_sentences(V.topics(spark, sf).select("id", "x").repartition("id"), ["id"], "x", DELIMS)
    return S.documents_of_sentences(pieces, ["id"], "piece", MIN_LEN, lambda p: T.packed_tokens(p, True, True, True), packed=True)


def topic_packed(spark, sf, most=None):
    """Documents with packed sentences, written once; ``most``: the first tokens of each, where no more are read."""
    short = lambda s: F.substring_index(s, " ", most) if most else s
    return written(topic_docs(spark, sf).select("id", "delim", F.transform("sentences", short).alias("sentences")), "topic-sentences")


def topic_pairs(spark, sf, most=None):
    p = S.pair_dataset(topic_packed(spark, sf, most), ["id"], SEED)
    return p.withColumn("A", S.unpack("A")).withColumn("B", S.unpack("B"))


def topic_pair_tokens(spark, sf):
    t = V.topics(spark, sf)
    return t.select("id", "y", T.pretokenize(F.col("topic"), True, True, True).alias("tt"),
                    T.pretokenize(F.col("x"), True, True, True).alias("xt"))


def topic_encoded(spark, sf):
    t = topic_pair_tokens(spark, sf)
    tt, xt = X.truncate_topic_pair("tt", "xt")
    t = t.withColumn("tokens", X.assemble_pair(tt, xt)).withColumn("_f", F.size(tt) + 2).withColumn("_s", F.size(xt) + 1)
    d = D.tokens_to_ids(t, ["id"], "tokens", topic_vocab(spark, sf), "ids")
    return (d.withColumn("segment_ids", X.segment_ids(F.col("_f"), F.col("_s")))
            .withColumn("input_mask", X.input_mask("ids")).withColumn("x", X.pad("ids")))


def topic_masked(spark, sf, vocab=None):
    return EN.masked_corpus(topic_docs(spark, sf), ["id"], vocab if vocab is not None else topic_vocab(spark, sf))


# ---- oracle pieces -------------------------------------------------------------
PT = lambda c: O.pretokenize_sql(c, True, True, True)
H = lambda cols, seed: O.h60(", ".join(f"CAST({c} AS VARCHAR)" for c in cols), seed)

PAIRS_CTES = f"""pos AS (SELECT id, delim, CAST(i AS INTEGER) AS pno, sentences[i] AS A, sentences[i + 1] AS B, 1 AS y
        FROM (SELECT id, delim, sentences, unnest(range(1, len(sentences))) AS i FROM docs WHERE len(sentences) > 1)),
d2 AS (SELECT * FROM docs WHERE len(sentences) > 1),
didx AS (SELECT row_number() OVER (ORDER BY {O.md5_key(['id', 'delim'], f'docs:{SEED}')}, id, delim) AS doc_idx, sentences FROM d2),
draws0 AS (SELECT id, delim, pno, {H(['id', 'delim', 'pno'], f'a:{SEED}')} % (SELECT count(*) FROM d2) + 1 AS ia,
                  {H(['id', 'delim', 'pno'], f'b:{SEED}')} % ((SELECT count(*) FROM d2) - 1) + 1 AS ib0,
                  {H(['id', 'delim', 'pno'], f'sa:{SEED}')} AS ha, {H(['id', 'delim', 'pno'], f'sb:{SEED}')} AS hb FROM pos),
draws AS (SELECT *, CASE WHEN ib0 >= ia THEN ib0 + 1 ELSE ib0 END AS ib FROM draws0),
neg AS (SELECT d.id, d.delim, d.pno, a.sentences[d.ha % len(a.sentences) + 1] AS A, b.sentences[d.hb % len(b.sentences) + 1] AS B, 0 AS y
        FROM draws d JOIN didx a ON a.doc_idx = d.ia JOIN didx b ON b.doc_idx = d.ib),
pairs AS (SELECT *, row_number() OVER (ORDER BY {O.md5_key(['id', 'delim', 'pno', 'y'], f'pairs:{SEED}')}, id, delim, pno, y) AS rank
          FROM (SELECT * FROM pos UNION ALL SELECT * FROM neg))"""

SQL_DOCS = f"""{O.TOPICS},
dl(delim) AS (VALUES ('.'), (';'), (',')),
pieces0 AS (SELECT id, delim, list_filter(string_split(x, delim), lambda p: length(p) > 0) AS ps FROM topics, dl WHERE x IS NOT NULL),
pieces AS (SELECT id, delim, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS sidx, unnest(ps) AS piece FROM pieces0),
tp AS (SELECT id, delim, sidx, {PT('piece')} AS tokens FROM pieces),
raw AS (SELECT id, delim, list(tokens ORDER BY sidx) AS raw FROM tp GROUP BY id, delim),
docs AS (SELECT id, delim, {O.merged_sentences_sql('raw', MIN_LEN)} AS sentences FROM raw),
{PAIRS_CTES}"""


def trunc_sql(a, b, T_=61, tie_b=True):
    ca, fa = (T_ + 1) // 2, T_ // 2
    na = f"least(len({a}), greatest({ca if tie_b else fa}, {T_} - len({b})))"
    nb = f"least(len({b}), greatest({fa if tie_b else ca}, {T_} - len({a})))"
    return f"list_slice({a}, 1, {na})", f"list_slice({b}, 1, {nb})"


def ids_ctes(src: str, keys: list[str], toks: str, out: str) -> str:
    k = ", ".join(keys)
    on = " AND ".join(f"s.{c} = g.{c}" for c in keys)
    return f"""{out}_ex AS (SELECT {k}, unnest({toks}) AS token, generate_subscripts({toks}, 1) AS pos FROM {src}),
{out}_g AS (SELECT {", ".join('e.' + c for c in keys)}, list(coalesce(v.id, 1) ORDER BY e.pos) AS ids FROM {out}_ex e LEFT JOIN vocab v ON v.token = e.token GROUP BY {", ".join('e.' + c for c in keys)}),
{out} AS (SELECT s.*, coalesce(g.ids, []::INTEGER[]) AS ids FROM {src} s LEFT JOIN {out}_g g ON {on})"""


TV = O.vocab_ctes("topics", "x", lower=True, strip=True)
TT_A, TT_B = trunc_sql("tt", "xt", tie_b=False)
SQL_TOPIC_ENC = f"""{O.TOPICS}, {TV},
tpt AS (SELECT id, y, {PT('topic')} AS tt, {PT('x')} AS xt FROM topics),
tr AS (SELECT id, y, {TT_A} AS tt2, {TT_B} AS xt2 FROM tpt),
asm AS (SELECT id, y, list_concat(['[CLS]'], tt2, ['[SEP]'], xt2, ['[SEP]']) AS tokens, len(tt2) + 2 AS f, len(xt2) + 1 AS s FROM tr),
{ids_ctes('asm', ['id'], 'tokens', 'enc0')},
enc AS (SELECT *, list_concat(list_transform(range(f), lambda z: 0), list_transform(range(s), lambda z: 1), list_transform(range(greatest(64 - f - s, 0)), lambda z: 0)) AS segment_ids,
        list_concat(list_transform(range(len(ids)), lambda z: 1), list_transform(range(greatest(64 - len(ids), 0)), lambda z: 0)) AS input_mask,
        list_concat(ids, list_transform(range(greatest(64 - len(ids), 0)), lambda z: 0)) AS x FROM enc0)"""

MASK_TAIL = f"""flat AS (SELECT id, delim, CAST(generate_subscripts(sentences, 1) - 1 AS INTEGER) AS sno, unnest(sentences) AS sentence FROM docs),
fl2 AS (SELECT id, delim, sno, list_concat(['[CLS]'], sentence, ['[SEP]']) AS tokens FROM flat),
{ids_ctes('fl2', ['id', 'delim', 'sno'], 'tokens', 'm0')},
m1 AS (SELECT id, delim, sno, CASE WHEN len(ids) > 64 THEN list_concat(list_slice(ids, 1, 63), [3]) ELSE ids END AS ids FROM m0),
m2 AS (SELECT *, len(ids) AS length, list_concat(ids, list_transform(range(greatest(64 - len(ids), 0)), lambda z: 0)) AS x FROM m1)"""

SQL_MASKED = f"""{SQL_DOCS}, {TV},
{MASK_TAIL}"""


def positions_sql(seed):
    key = "concat_ws(':', CAST(id AS VARCHAR), CAST(delim AS VARCHAR), CAST(sno AS VARCHAR), CAST(i AS VARCHAR), " + O.q(seed) + ")"
    return (f"CASE WHEN length >= 3 THEN list_transform(list_slice(list_sort(list_transform(range(1, greatest(length - 2, 1) + 1), "
            f"lambda i: {{'o': md5({key}), 'i': CAST(i AS INTEGER)}})), 1, CAST(floor(length * 0.15::DOUBLE) AS INTEGER)), lambda s: s.i) ELSE []::INTEGER[] END")


def corrupt_sql(seed, vsize: str):
    def h(tag):
        key = "concat_ws(':', CAST(id AS VARCHAR), CAST(delim AS VARCHAR), CAST(sno AS VARCHAR), CAST(i - 1 AS VARCHAR), " + O.q(f"{tag}:{seed}") + ")"
        return f"('0x' || substr(md5({key}), 1, 15))::BIGINT"
    return (f"list_transform(x, lambda v, i: CASE WHEN NOT list_contains(positions, i - 1) THEN v "
            f"WHEN {h('u')} / 1152921504606846976.0 < 0.8 THEN 4 WHEN {h('u')} / 1152921504606846976.0 < 0.9 THEN CAST({h('r')} % {vsize} AS INTEGER) ELSE v END)")


def masked_sql(epoch: int, base: str | None = None) -> str:
    s = f"{SEED}:{epoch}"
    return f"""WITH {base or SQL_MASKED},
m3 AS (SELECT *, {positions_sql('pos:' + s)} AS positions, (SELECT count(*) FROM vocab) AS vsize FROM m2),
m4 AS (SELECT *, list_distinct(list_transform(positions, lambda i: x[i + 1])) AS targets, {corrupt_sql(s, 'vsize')} AS masked_x FROM m3)
SELECT id, delim, sno, length, array_to_string(positions, ' ') AS positions, array_to_string(list_sort(targets), ' ') AS targets,
       array_to_string(masked_x, ' ') AS masked_x FROM m4"""


# ---- queries -------------------------------------------------------------------
@register("split_sentences", f"WITH {SQL_DOCS} SELECT id, delim, sidx, piece FROM pieces")
def q_split(spark, sf):
    return S.split_sentences(V.topics(spark, sf), ["id"], "x", DELIMS)


@register("drop_empty_sentences", f"WITH {SQL_DOCS} SELECT id, delim, CAST(count(*) AS BIGINT) AS n_pieces FROM pieces GROUP BY id, delim")
def q_drop_empty_sent(spark, sf):
    return S.split_sentences(V.topics(spark, sf), ["id"], "x", DELIMS).groupBy("id", "delim").agg(F.count(F.lit(1)).alias("n_pieces"))


@register("merge_short_sentences", f"WITH {SQL_DOCS} SELECT id, delim, {O.sents_str('sentences')} AS sentences FROM docs")
def q_merge(spark, sf):
    return topic_docs(spark, sf).select("id", "delim", F.array_join("sentences", " | ").alias("sentences"))


@register("flatten_sentences", f"""WITH {SQL_DOCS} SELECT id, delim, sno, array_to_string(sentence, ' ') AS sentence FROM
(SELECT id, delim, CAST(generate_subscripts(sentences, 1) - 1 AS INTEGER) AS sno, unnest(sentences) AS sentence FROM docs)""")
def q_flatten(spark, sf):
    return S.flatten_sentences(topic_docs(spark, sf), ["id"]).select("id", "delim", "sno", "sentence")


@register("min_two_sentences", f"WITH {SQL_DOCS} SELECT id, delim, CAST(len(sentences) AS INTEGER) AS n FROM docs WHERE len(sentences) > 1")
def q_min_two(spark, sf):
    return S.min_two_sentences(topic_docs(spark, sf)).select("id", "delim", F.size("sentences").alias("n"))


@register("adjacent_pairs", f"WITH {SQL_DOCS} SELECT id, delim, pno, array_to_string(A, ' ') AS A, array_to_string(B, ' ') AS B, y FROM pos")
def q_adjacent(spark, sf):
    return S.adjacent_pairs(topic_docs(spark, sf), ["id"]).select("id", "delim", "pno", "A", "B", "y")


@register("negative_pairs", f"WITH {SQL_DOCS} SELECT id, delim, pno, array_to_string(A, ' ') AS A, array_to_string(B, ' ') AS B, y FROM neg")
def q_negative(spark, sf):
    docs = topic_packed(spark, sf)
    return S.negative_pairs(docs, S.adjacent_pairs(docs, ["id"]), ["id"], SEED).select("id", "delim", "pno", "A", "B", "y")


@register("pair_dataset", f"WITH {SQL_DOCS} SELECT id, delim, pno, y, rank FROM pairs")
def q_pairs(spark, sf):
    return topic_pairs(spark, sf).select("id", "delim", "pno", "y", "rank")


TA, TB = trunc_sql("A", "B")


@register("truncate_pair", f"WITH {SQL_DOCS} SELECT id, delim, pno, y, array_to_string({TA}, ' ') AS A, array_to_string({TB}, ' ') AS B FROM pairs")
def q_trunc_pair(spark, sf):
    # a pair never keeps more than its target of one sentence, and longer ones are all cut alike
    p = topic_pairs(spark, sf, X.L - 3)
    a, b = X.truncate_pair("A", "B")
    return p.select("id", "delim", "pno", "y", F.array_join(a, " ").alias("A"), F.array_join(b, " ").alias("B"))


@register("truncate_topic_pair", f"WITH {SQL_TOPIC_ENC} SELECT id, array_to_string(tt2, ' ') AS topic, array_to_string(xt2, ' ') AS x FROM tr")
def q_trunc_topic(spark, sf):
    t = topic_pair_tokens(spark, sf)
    tt, xt = X.truncate_topic_pair("tt", "xt")
    return t.select("id", F.array_join(tt, " ").alias("topic"), F.array_join(xt, " ").alias("x"))


@register("truncate_single", f"WITH {SQL_TOPIC_ENC} SELECT id, array_to_string(list_slice(xt, 1, 61), ' ') AS x FROM tpt")
def q_trunc_single(spark, sf):
    return topic_pair_tokens(spark, sf).select("id", F.array_join(X.truncate_single("xt"), " ").alias("x"))


@register("assemble_single", f"WITH {SQL_TOPIC_ENC} SELECT id, array_to_string(list_concat(['[CLS]'], list_slice(xt, 1, 61), ['[SEP]']), ' ') AS tokens FROM tpt")
def q_asm_single(spark, sf):
    return topic_pair_tokens(spark, sf).select("id", F.array_join(X.assemble_single(X.truncate_single("xt")), " ").alias("tokens"))


@register("assemble_pair", f"WITH {SQL_TOPIC_ENC} SELECT id, array_to_string(tokens, ' ') AS tokens FROM asm")
def q_asm_pair(spark, sf):
    t = topic_pair_tokens(spark, sf)
    tt, xt = X.truncate_topic_pair("tt", "xt")
    return t.select("id", F.array_join(X.assemble_pair(tt, xt), " ").alias("tokens"))


@register("segment_ids", f"WITH {SQL_TOPIC_ENC} SELECT id, array_to_string(segment_ids, ' ') AS segment_ids FROM enc")
def q_segments(spark, sf):
    return topic_encoded(spark, sf).select("id", js("segment_ids"))


@register("pad_and_mask", f"WITH {SQL_TOPIC_ENC} SELECT id, array_to_string(x, ' ') AS x, array_to_string(input_mask, ' ') AS input_mask FROM enc")
def q_pad(spark, sf):
    return topic_encoded(spark, sf).select("id", js("x"), js("input_mask"))


@register("check_lengths", f"WITH {SQL_TOPIC_ENC} SELECT id FROM enc WHERE len(x) = 64 AND len(input_mask) = 64 AND len(segment_ids) = 64")
def q_check(spark, sf):
    return X.check_lengths(topic_encoded(spark, sf)).select("id")


@register("tensor_projection", f"""WITH {SQL_TOPIC_ENC}, {O.TOPICS.replace('topics AS', 'lbl AS')},
m AS (SELECT category, CAST(row_number() OVER (ORDER BY category) - 1 AS BIGINT) AS idx FROM (SELECT DISTINCT y AS category FROM topics))
SELECT enc.id, array_to_string(x, ' ') AS x, array_to_string(input_mask, ' ') AS input_mask, array_to_string(segment_ids, ' ') AS segment_ids, m.idx AS y
FROM enc JOIN m ON m.category = enc.y""")
def q_tensor(spark, sf):
    e = topic_encoded(spark, sf)
    mp = L.ordinal_fit(V.topics(spark, sf), "y")
    e = L.ordinal_transform(e, mp, "y", "y")
    t = X.tensor_projection(e, ("x", "input_mask", "segment_ids"), "y", keys=("id",))
    return t.select("id", js("x"), js("input_mask"), js("segment_ids"), "y")


@register("truncate_ids", f"WITH {SQL_MASKED} SELECT id, delim, sno, length, array_to_string(x, ' ') AS x FROM m2")
def q_trunc_ids(spark, sf):
    return topic_masked(spark, sf).select("id", "delim", "sno", "length", js("x"))


def _masked(spark, sf, epoch):
    v = topic_vocab(spark, sf)
    n = v.count()
    m = EN.encode_masked(topic_masked(spark, sf, v), ["id"], n, SEED, epoch)
    return m.select("id", "delim", "sno", "length", js("positions"),
                    F.array_join(F.array_sort("targets").cast("array<string>"), " ").alias("targets"), js("masked_x"))


@register("mask_positions", masked_sql(0))
def q_mask_positions(spark, sf):
    return _masked(spark, sf, 0)


@register("resample_epoch", masked_sql(1))
def q_resample(spark, sf):
    return _masked(spark, sf, 1)


@register("batches", f"WITH {O.label_chain_ctes(SEED)} SELECT id, source, rank, CAST(floor((rank - 1) / 16) AS BIGINT) AS batch_id FROM split_rows")
def q_batches(spark, sf):
    return X.batches(split_table(spark, sf)).select("id", "source", "rank", "batch_id")


@register("train_steps", f"WITH {O.label_chain_ctes(SEED)} SELECT CAST(ceil(count(*) / 16) AS BIGINT) AS steps FROM split_rows WHERE split = 'train'")
def q_steps(spark, sf):
    return X.train_steps(L.split_filter(split_table(spark, sf), "train"))


def _piece_docs_sql(base: str, src: str, text: str, delims, repair: bool) -> str:
    """Sentences in word pieces from the table ``src`` of the CTEs ``base``."""
    keys = ["id", "delim", "sidx"]
    dl = ", ".join(f"({O.q(d)})" for d in delims)
    tokens = O.repair_sql("tokens") if repair else "tokens"
    return f"""{base}, pdl(delim) AS (VALUES {dl}),
pp0 AS (SELECT id, delim, list_filter(string_split({text}, delim), lambda p: length(p) > 0) AS ps FROM {src}, pdl WHERE {text} IS NOT NULL),
ppieces AS (SELECT id, delim, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS sidx, unnest(ps) AS piece FROM pp0),
{O.tokenize_ctes('ptok', 'ppieces', keys, 'piece')}, {O.wordpiece_ctes('ptok_words')},
{O.tokenize_join_cte('ptok', 'ppieces', keys)},
praw AS (SELECT id, delim, list({tokens} ORDER BY sidx) AS raw FROM ptok GROUP BY id, delim),
docs AS (SELECT id, delim, {O.merged_sentences_sql('raw', MIN_LEN)} AS sentences FROM praw)"""


def _posts_docs_sql() -> str:
    from threadmill.plans.q_vocab import VOCAB_CTE

    return _piece_docs_sql(VOCAB_CTE, "cleaned", "text", ["."], True)


def _topics_docs_sql() -> str:
    stripped = f"stripped AS (SELECT id, regexp_replace(x, {O.url_re()}, '', 'g') AS text FROM topics)"
    return _piece_docs_sql(f"{O.TOPICS}, {TV}, {stripped}", "stripped", "text", DELIMS, False)


def _encode_pairs_sql(docs: str) -> str:
    return f"""WITH {docs}, {PAIRS_CTES},
ptr AS (SELECT id, delim, pno, y, rank, {TA} AS a2, {TB} AS b2 FROM pairs),
pasm AS (SELECT id, delim, pno, y, rank, list_concat(['[CLS]'], a2, ['[SEP]'], b2, ['[SEP]']) AS tokens, len(a2) + 2 AS f, len(b2) + 1 AS s FROM ptr),
{ids_ctes('pasm', ['id', 'delim', 'pno', 'y'], 'tokens', 'penc0')},
penc AS (SELECT *, list_concat(list_transform(range(f), lambda z: 0), list_transform(range(s), lambda z: 1), list_transform(range(greatest(64 - f - s, 0)), lambda z: 0)) AS segment_ids,
         list_concat(list_transform(range(len(ids)), lambda z: 1), list_transform(range(greatest(64 - len(ids), 0)), lambda z: 0)) AS input_mask,
         list_concat(ids, list_transform(range(greatest(64 - len(ids), 0)), lambda z: 0)) AS x FROM penc0)
SELECT id, delim, pno, rank, array_to_string(tokens, ' ') AS tokens, array_to_string(x, ' ') AS x, array_to_string(input_mask, ' ') AS input_mask,
       array_to_string(segment_ids, ' ') AS segment_ids, y FROM penc"""


def _encode_masked_sql(docs: str) -> str:
    sql = masked_sql(0, f"{docs}, {MASK_TAIL}")
    head, _ = sql.split("\nSELECT id, delim, sno, length")
    return head + """
SELECT id, delim, sno, length, array_to_string(x, ' ') AS x, array_to_string(positions, ' ') AS positions,
       array_to_string(list_sort(targets), ' ') AS targets, array_to_string(masked_x, ' ') AS masked_x FROM m4"""


def _encode_claims_sql() -> str:
    from threadmill.plans.q_vocab import VOCAB_CTE

    keys = ["source", "id"]
    return f"""WITH {VOCAB_CTE}, {O.label_chain_ctes(SEED, with_posts=False)},
lab AS (SELECT source, id, x, y, split FROM split_rows WHERE x IS NOT NULL),
ymap AS (SELECT category, CAST(row_number() OVER (ORDER BY category) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT y AS category FROM lab WHERE y IS NOT NULL AND split = 'train')),
lab2 AS (SELECT l.source, l.id, l.x, m.idx AS y FROM lab l JOIN ymap m ON m.category = l.y),
{O.tokenize_ctes('ctok', 'lab2', keys, 'x')}, {O.wordpiece_ctes('ctok_words')},
{O.tokenize_join_cte('ctok', 'lab2', keys)},
casm AS (SELECT source, id, y, list_concat(['[CLS]'], list_slice({O.repair_sql('tokens')}, 1, 61), ['[SEP]']) AS tokens FROM ctok),
{ids_ctes('casm', keys, 'tokens', 'cenc0')},
cenc AS (SELECT *, list_concat(list_transform(range(len(ids)), lambda z: 1), list_transform(range(greatest(64 - len(ids), 0)), lambda z: 0)) AS input_mask,
         list_concat(ids, list_transform(range(greatest(64 - len(ids), 0)), lambda z: 0)) AS xx FROM cenc0)
SELECT source, id, array_to_string(tokens, ' ') AS tokens, array_to_string(xx, ' ') AS x, array_to_string(input_mask, ' ') AS input_mask,
       array_to_string(list_transform(range(64), lambda z: 0), ' ') AS segment_ids, y FROM cenc"""


@register("encode_claims", _encode_claims_sql())
def q_encode_claims(spark, sf):
    c = cleaned(spark, sf)
    vocab = posts_vocab(spark, sf, c)
    lab = materialize(split_table(spark, sf).select("source", "id", "x", "y", "split"))
    mapping = L.ordinal_fit(L.split_filter(lab, "train"), "y")
    e = EN.encode_claims(lab.drop("split"), vocab, mapping=mapping, key_cols=["source", "id"])
    return e.select("source", "id", js("tokens"), js("x"), js("input_mask"), js("segment_ids"), "y")


def _encode_topic_sql() -> str:
    return f"""WITH {O.TOPICS}, {TV},
tb AS (SELECT id, x, topic, CASE WHEN y IS NOT DISTINCT FROM 'NoArgument' THEN 'NoArgument' ELSE 'Argument' END AS y FROM topics),
ymap AS (SELECT category, CAST(row_number() OVER (ORDER BY category) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT y AS category FROM tb WHERE y IS NOT NULL)),
tb2 AS (SELECT t.id, t.x, t.topic, m.idx AS y FROM tb t JOIN ymap m ON m.category = t.y),
{O.tokenize_ctes('xtok', 'tb2', ['id'], 'x')}, {O.tokenize_ctes('ttok', 'tb2', ['id'], 'topic')},
allw AS (SELECT word FROM xtok_words UNION ALL SELECT word FROM ttok_words), {O.wordpiece_ctes('allw')},
{O.tokenize_join_cte('xtok', 'tb2', ['id'])}, {O.tokenize_join_cte('ttok', 'tb2', ['id'])},
tt0 AS (SELECT x.id, x.y, t.tokens AS tt, x.tokens AS xt FROM xtok x JOIN ttok t USING (id)),
tr2 AS (SELECT id, y, {TT_A} AS tt2, {TT_B} AS xt2 FROM tt0),
asm2 AS (SELECT id, y, list_concat(['[CLS]'], tt2, ['[SEP]'], xt2, ['[SEP]']) AS tokens, len(tt2) + 2 AS f, len(xt2) + 1 AS s FROM tr2),
{ids_ctes('asm2', ['id'], 'tokens', 'tenc0')},
tenc AS (SELECT *, list_concat(list_transform(range(f), lambda z: 0), list_transform(range(s), lambda z: 1), list_transform(range(greatest(64 - f - s, 0)), lambda z: 0)) AS segment_ids,
         list_concat(list_transform(range(len(ids)), lambda z: 1), list_transform(range(greatest(64 - len(ids), 0)), lambda z: 0)) AS input_mask,
         list_concat(ids, list_transform(range(greatest(64 - len(ids), 0)), lambda z: 0)) AS xx FROM tenc0)
SELECT id, array_to_string(tokens, ' ') AS tokens, array_to_string(xx, ' ') AS x, array_to_string(input_mask, ' ') AS input_mask,
       array_to_string(segment_ids, ' ') AS segment_ids, y FROM tenc"""


@register("encode_claims_topic", _encode_topic_sql())
def q_encode_topic(spark, sf):
    vocab = topic_vocab(spark, sf)
    t = V.topics(spark, sf).withColumn("y", L.binarize_labels("y"))
    e = EN.encode_claims(t, vocab, mode="topic")
    return e.select("id", js("tokens"), js("x"), js("input_mask"), js("segment_ids"), "y")


def posts_pieces(spark, sf):
    """Sentences of the cleaned posts in word pieces, and the vocabulary."""
    c = cleaned(spark, sf)
    vocab = posts_vocab(spark, sf, c)
    return EN.sentence_docs(c, ["id"], "text", vocab), vocab


def topic_pieces(spark, sf):
    """The topic form: links removed, then a segmentation for each delimiter."""
    vocab = topic_vocab(spark, sf)
    t = V.topics(spark, sf).withColumn("x", C.strip_urls("x"))
    return EN.sentence_docs(t, ["id"], "x", vocab, DELIMS, repair=False), vocab


def _pairs_out(docs, vocab):
    e = EN.encode_pairs(docs, ["id"], vocab, SEED)
    return e.select("id", "delim", "pno", "rank", js("tokens"), js("x"), js("input_mask"), js("segment_ids"), "y")


def _masked_out(docs, vocab):
    m = EN.encode_masked(EN.masked_corpus(docs, ["id"], vocab), ["id"], vocab.count(), SEED, 0)
    return m.select("id", "delim", "sno", "length", js("x"), js("positions"),
                    F.array_join(F.array_sort("targets").cast("array<string>"), " ").alias("targets"), js("masked_x"))


@register("encode_pairs", _encode_pairs_sql(_posts_docs_sql()))
def q_encode_pairs(spark, sf):
    return _pairs_out(*posts_pieces(spark, sf))


@register("encode_pairs_topic", _encode_pairs_sql(_topics_docs_sql()))
def q_encode_pairs_topic(spark, sf):
    return _pairs_out(*topic_pieces(spark, sf))


@register("encode_masked", _encode_masked_sql(_posts_docs_sql()))
def q_encode_masked(spark, sf):
    return _masked_out(*posts_pieces(spark, sf))


@register("encode_masked_topic", _encode_masked_sql(_topics_docs_sql()))
def q_encode_masked_topic(spark, sf):
    return _masked_out(*topic_pieces(spark, sf))


def _masked_sub(cols):
    sql = masked_sql(0)
    head, _ = sql.split("\nSELECT id, delim, sno, length")
    sel = {"targets": "array_to_string(list_sort(targets), ' ') AS targets", "masked_x": "array_to_string(masked_x, ' ') AS masked_x",
           "positions": "array_to_string(positions, ' ') AS positions"}
    return head + "\nSELECT id, delim, sno, " + ", ".join(sel[c] for c in cols) + " FROM m4"


@register("mask_targets", _masked_sub(["positions", "targets"]))
def q_mask_targets(spark, sf):
    return _masked(spark, sf, 0).select("id", "delim", "sno", "positions", "targets")


@register("mask_corrupt", _masked_sub(["masked_x"]))
def q_mask_corrupt(spark, sf):
    return _masked(spark, sf, 0).select("id", "delim", "sno", "masked_x")
