"""Operator 7: secret scan with a random forest that removes false positives.

Candidates, found in whole texts, are private key blocks from their first to their last line, passwords between
``://user:`` and ``@``, runs of 16 or more characters of ``A-Za-z0-9+/_-`` (and up to
two ``=`` after them) with a letter and a digit, runs of ``LETTERS_ONLY`` or more letters that are not one letter repeated, and whatever
stands assigned or in quotes after a secret word, after a secret word and ``is`` or ``was``, or after ``bearer``: ``VALUE`` or more printable
characters up to the closing quote (blanks included where the quote is assigned), or to a
blank, quote, comma or semicolon. A forest (Spark ML)
judges each by its length, its character transitions (between letters, digits,
cases and separators), its character shares, its dictionary coverage, its path and its neighbouring
words, and removes what only looks like a secret: digests, slugs, identifiers, placeholders.

The dictionary holds the words that all documents use at least ``DICTIONARY_USES`` times. It is counted with partial
sums and only ever joined to the letter runs of candidates; its size plays no role for memory.

The forest is trained from labelled findings (columns value, before, after,
path, label). ``labelled_findings`` makes a set of bounded size from the corpus: values and contexts of
known kinds, set between words of the ``SAMPLE_DOCS`` documents with the smallest hash of their id.

Only DataFrame functions and Spark ML run; a text never leaves its row whole unless it has a candidate.

Defined results: null, empty and clean texts give no findings. Findings are reported once for repeated rows
(equal id, path and text). A null id or path stays null. ``start`` and ``stop`` count
characters of the text from 0; ``stop`` is the place after the last one. ``redact`` keeps all rows and all
columns, whatever their names, and changes only the text of rows with a secret.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmill.llm.common import cut, fresh

SIGNS = "A-Za-z0-9+/_-"
VALUE, URL_VALUE, LETTERS_ONLY = 8, 4, 24
SECRETS = "token|secret|passw|passphrase|pwd|api.?key|access.?key|private.?key|credential|auth|bearer"
#: Before a value: a secret word, the rest of its name, and an assignment, an opening quote or both.
ASSIGNED = rf"(?i:{SECRETS})[A-Za-z0-9_.-]{{0,16}}[\"'`]?[ \t]{{0,3}}(?:[:=][=>]?[ \t]{{0,3}})"
QUOTED = rf"(?<=[\"'`])(?<=(?i:{SECRETS})[A-Za-z0-9_.-]{{0,16}}[\"'`]?[ \t]{{0,3}}(?:[:=][=>]?[ \t]{{0,3}})?"
#: Before a value: a secret word with "is" or "was", or "bearer".
SAID = rf"(?:(?i:{SECRETS})[A-Za-z0-9_.-]{{0,16}}[\"'`]?[ \t]{{1,3}}(?i:is|was):?|(?i:bearer):?)[ \t]{{1,3}}"
URL_USER = r"://[^\s/:@\"'`]{0,64}:"
BLOCK_NAME = r"[A-Z0-9 ]{0,40}PRIVATE KEY[A-Z ]{0,10}-----"
#: From the first line of a key block to its last; the lines between hold no two dashes in a row.
BLOCK = rf"-----BEGIN {BLOCK_NAME}[^-]*+(?:-[^-]++){{0,20}}+-----END {BLOCK_NAME}"
#: All but blocks begin after no sign; the short look back comes before the long one, which few places then need.
CANDIDATE = rf"{BLOCK}|(?<![{SIGNS}])(?:" + "|".join([
    rf"(?<=:)(?<={URL_USER})[!-~&&[^\"'`/:@]]{{{URL_VALUE},}}+(?=@)",
    *(rf"(?<={q})(?<={ASSIGNED}{q})(?=[!-~])[ -~&&[^{q}]]{{{VALUE},}}+(?={q})" for q in "\"'`"),
    *(rf"{QUOTED}{q})(?=[!-~]{{{VALUE}}})[!-~&&[^{q}]]{{{VALUE},}}+(?={q})" for q in "\"'`"),
    rf"(?<=[:=> \t])(?<=[:=>][ \t]{{0,3}})(?<={ASSIGNED})[!-~&&[^\"'`,;:=> \t]][!-~&&[^\"'`,;]]{{{VALUE - 1},}}+",
    rf"(?<=[ \t])(?<=(?i:is|was|bearer):?[ \t]{{1,3}})(?<={SAID})[!-~&&[^\"'`,;:=> \t]][!-~&&[^\"'`,;]]{{{VALUE - 1},}}+",
    r"(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])" + rf"[{SIGNS}]{{16,}}+={{0,2}}",
    rf"(?!([A-Za-z])\1*+(?![A-Za-z]))[A-Za-z]{{{LETTERS_ONLY},}}+(?![{SIGNS}])",
]) + ")"
CONTEXT = 80
SECRET_WORDS = rf"(?i)({SECRETS}|\bkeys?\b)"
PREFIX = r"^(-----BEGIN|AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk_(live|test)_|sk-|xox[abprs]-|AIza|npm_|hf_|eyJ)"
PLAIN_WORDS = r"(?i)(example|sample|dummy|placeholder|your|commit|checksum|digest|sha\d|md5|hash|uuid|revision|build|version|http|href|src=|img|isbn|order)"
TEST_PATH = r"(?i)(^|[/_.-])(tests?|fixtures?|examples?|samples?|docs?|mocks?)([/_.-]|$)"
MASK = "[SECRET]"
TREES, DEPTH, SEED = 30, 7, 11
SAMPLE_DOCS, KINDS, DICTIONARY_USES = 300, 32, 20

FEATURES = [
    "length", "digits", "capitals", "hex", "separators", "kinds", "letter_digit", "case_change", "longest_word", "vowels", "vowel_change", "coverage",
    "test_path", "secret_word", "secret_near", "plain_word", "assigned", "quoted", "signs", "blanks", "prefix",
]


def _share(value: Column, signs: str) -> Column:
    return 1 - F.length(F.regexp_replace(value, signs, "")) / F.length(value)


def _changes(value: Column, places: str) -> Column:
    return (F.length(F.regexp_replace(value, places, ".")) - F.length(value)) / F.length(value)


def shape_features(df: DataFrame) -> DataFrame:
    """All features but the coverage, from value, before, after and path."""
    v, near = F.col("value"), F.concat(F.coalesce("before", F.lit("")), F.lit(" | "), F.coalesce("after", F.lit("")))
    before = F.coalesce("before", F.lit(""))
    close = F.substring(before, -24, 24)
    flag = lambda c: c.cast("double")
    return df.withColumns({
        "length": F.least(F.length(v), F.lit(400)).cast("double"),
        "digits": _share(v, "[0-9]"),
        "capitals": _share(v, "[A-Z]"),
        "hex": _share(v, "[0-9A-Fa-f]"),
        "separators": _share(v, "[+/_-]"),
        "kinds": F.size(F.array_distinct(F.split(F.lower(v), ""))) / F.length(v),
        "letter_digit": _changes(v, "(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"),
        "case_change": _changes(v, "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        "longest_word": F.array_max(F.transform(F.split(v, "[^A-Za-z]+"), lambda w: F.length(w))) / F.length(v),
        "vowels": _share(v, "(?i)[aeiouy]"),
        "vowel_change": _changes(v, "(?i)(?<=[aeiouy])(?=[b-df-hj-np-tv-xz])|(?<=[b-df-hj-np-tv-xz])(?=[aeiouy])"),
        "test_path": flag(F.coalesce(F.col("path"), F.lit("")).rlike(TEST_PATH)),
        "secret_word": flag(near.rlike(SECRET_WORDS)),
        "secret_near": flag(close.rlike(SECRET_WORDS) | before.rlike(URL_USER + "$")),
        "plain_word": flag(F.concat(close, v).rlike(PLAIN_WORDS)),
        "assigned": flag(before.rlike(r"(?i)([:=]>?|\b(is|was|bearer):?)\s*[\"'`]?$")),
        "quoted": flag(before.rlike(r"[\"'`]$")),
        "signs": _share(v, "[^A-Za-z0-9+/_= -]"),
        "blanks": _share(v, " "),
        "prefix": flag(v.rlike(PREFIX)),
    })


def dictionary(docs: DataFrame, text_col: str = "text", uses: int = DICTIONARY_USES) -> DataFrame:
    """Column word: the words of 4 to 20 letters a-z (case folded) that stand alone at least ``uses`` times in all texts."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text_col)), r"[^a-z0-9+/_-]+")).alias("word"))
    words = words.where(F.length("word").between(4, 20) & F.col("word").rlike("^[a-z]+$"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= uses).select("word")


def with_coverage(df: DataFrame, words: DataFrame) -> DataFrame:
    """Add ``coverage``: the share of the value's characters in letter runs that are words."""
    values = df.select("value").distinct()
    runs = values.select("value", F.explode(F.split(F.lower("value"), "[^a-z]+")).alias("run")).where(F.length("run") >= 4)
    hit = runs.join(words.withColumnRenamed("word", "run"), "run").groupBy("value").agg(F.sum(F.length("run")).alias("_s_covered"))
    return df.join(hit, "value", "left").withColumn("coverage", F.coalesce("_s_covered", F.lit(0)) / F.length("value")).drop("_s_covered")


def _row_key(id_col: str, path_col: str | None, text_col: str) -> Column:
    """Digest of what makes a row: id, path and text."""
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    mark = lambda c: F.coalesce(F.concat(F.lit("+"), c), F.lit("-"))
    return F.sha2(F.concat_ws("\n", mark(F.col(id_col).cast("string")), mark(path), F.col(text_col)), 256)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """One row for each candidate of each distinct row: row_key, pos (from 0), doc_id, path, value, before, after, start."""
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    rows = docs.where(F.col(text_col).rlike(CANDIDATE)).select(
        _row_key(id_col, path_col, text_col).alias("row_key"), F.col(id_col).alias("doc_id"), path.alias("path"),
        F.regexp_extract_all(F.col(text_col), F.lit(CANDIDATE), F.lit(0)).alias("hits"), F.split(F.col(text_col), CANDIDATE, -1).alias("gaps"),
    )
    rows = rows.dropDuplicates(["row_key"])
    hit = lambda i: F.coalesce(F.get(F.col("hits"), i), F.lit(""))
    one = rows.select(
        "row_key", "doc_id", "path",
        F.posexplode(F.transform(F.col("hits"), lambda v, i: F.struct(
            v.alias("value"),
            F.substring(F.concat(hit(i - 1), F.get(F.col("gaps"), i)), -CONTEXT, CONTEXT).alias("before"),
            F.substring(F.concat(F.get(F.col("gaps"), i + 1), hit(i + 1)), 1, CONTEXT).alias("after"),
            F.length(F.get(F.col("gaps"), i)).alias("gap"),
        ))).alias("pos", "c"),
    ).select("row_key", "doc_id", "path", "pos", "c.*")
    upto = Window.partitionBy("row_key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.col("gap") + F.length("value")).over(upto) - F.length("value")
    return one.withColumn("start", start).drop("gap")


def labelled_findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Findings of known kind between words of sample documents: value, before, after, path, label (1: a secret)."""
    chosen = (
        docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
        .select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
        .withColumn("order", F.md5(F.concat("id", F.lit(":findings"))))
    )
    ids = chosen.select("order", "id").orderBy("order", "id").limit(sample_docs).distinct()
    rows = chosen.join(F.broadcast(ids), ["order", "id"], "left_semi").dropDuplicates(["id"])
    words = F.filter(F.split("text", r"[^\p{L}]+"), lambda w: F.length(w) >= 2)
    rows = rows.select("id", F.when(F.size(words) > 0, words).otherwise(F.array(F.lit("word"))).alias("w"))
    rows = cut(rows)
    rows = rows.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(KINDS - 1))))
    draw = lambda s, m: F.pmod(F.xxhash64("id", "n", F.lit(s)), F.lit(m)).cast("int")
    word = lambda s: F.element_at("w", F.pmod(F.xxhash64("id", "n", F.lit(s)), F.size("w")).cast("int") + 1)
    one = lambda s, *of: F.get(F.array(*[F.lit(x) if isinstance(x, str) else x for x in of]), draw(s, len(of)))
    part = lambda v, s, least, most: v.substr(F.lit(1), draw(s, most - least + 1) + least)
    raw = F.sha2(F.concat_ws(":", "id", "n", F.lit("raw")), 512)
    b64 = F.translate(F.base64(F.unhex(raw)), "=\r\n", "")
    alnum = F.translate(b64, "+/", "xY")
    letters, digits = F.translate(alnum, "0123456789", "GhJkMnPqRs"), F.translate(raw, "abcdef", "402975")
    # what the values are made of is written once: nested any deeper, the expressions outgrow generated code
    pieces = {"raw": raw, "b64": b64, "alnum": alnum, "letters": letters, "digits": digits, **{f"w_{s}": word(s) for s in "abcdefghijklmop"}}
    rows = cut(rows.select("id", "n", *[c.alias(name) for name, c in pieces.items()]))
    raw, b64, alnum, letters, digits = map(F.col, ("raw", "b64", "alnum", "letters", "digits"))
    word = lambda s: F.col(f"w_{s}")
    dashed = F.concat_ws("-", *[F.substring(raw, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    sign = lambda s: one(s, *"!@#$%^&*?.~")
    signed = F.concat(part(alnum, "m", 3, 7), sign("n"), F.substring(alnum, 20, 3), sign("o"), part(F.substring(alnum, 30, 8), "p", 1, 8))
    known = F.concat(one("q", "AKIA", "ghp_", "sk_live_", "xoxb-", "AIza", "glpat-", "npm_"), part(alnum, "r", 16, 40))
    between = one("s", "-", "_", "/")
    slug = F.lower(F.concat(word("a"), between, word("b"), between, word("c"), between, word("d"), between, one("t", "2", "17", "2024")))
    name = F.concat(F.lower(word("e")), F.initcap(word("f")), F.initcap(word("g")), one("u", "Factory2", "Handler", "V3", "Service"))
    filler = F.concat(one("v", "your-", "example-", "my-dummy-", "sample_", "placeholder-"), one("w", "api-key-here-123", "token-goes-here", "password1", "secret-2"))
    dated = F.concat(F.lit("2024-0"), draw("x", 9) + 1, F.lit("-02T03-04-"), F.substring(digits, 1, 2))
    one_case = part(one("c", F.lower(letters), F.upper(letters)), "len", 24, 48)
    half = lambda c, first: F.substring(c, 1, 6) if first else F.when(F.length(c) > 6, F.substring(c, -6, 6)).otherwise(c)
    coined = F.lower(F.concat(half(word("h"), True), half(word("p"), False)))  # like a word, but in no dictionary
    phrase = F.concat_ws(" ", F.lower(word("a")), F.lower(word("b")), one("s", F.lower(word("c")), digits.substr(1, 3)), F.lower(word("d")))
    block_name = one("bn", "", "RSA ", "EC ", "OPENSSH ")
    block = F.concat(F.lit("-----BEGIN "), block_name, F.lit("PRIVATE KEY-----\n"), b64, F.lit("\n-----END "), block_name, F.lit("PRIVATE KEY-----"))
    # values, names and what joins them are drawn one by one, so that no form belongs to one context
    hexes = one("hex", part(raw, "len", 32, 64), F.substring(raw, 1, 32), F.substring(raw, 1, 40), F.upper(F.substring(raw, 1, 40)), F.substring(raw, 1, 64))
    secret = one("value", hexes, hexes, part(b64, "len", 16, 64), part(alnum, "len", 12, 48), part(letters, "len", 12, 48), part(digits, "len", 8, 24), signed, signed, known, one_case, one_case, F.lower(part(alnum, "len", 10, 20)))
    digest = one("value", hexes, hexes, hexes, dashed, part(digits, "len", 10, 24), part(b64, "len", 16, 44))
    common = one("value", slug, slug, name, filler, filler, F.concat(F.lit("your "), F.lower(word("e")), F.lit(" here")), F.lower(word("h")), F.initcap(word("h")), coined, coined, dated, F.concat(one("y", "img/", "assets/"), slug))
    named = one("name", "token", "TOKEN", "access_token", "api_key", "apiKey", "API-KEY", "secret", "client_secret", "password", "passwd", "PWD", "auth", "access key", "private_key", "credential", "passphrase", "the key", "key")
    joined = one("join", " = \"", "=\"", ": \"", "\": \"", " = '", ": '", "=", ": ", " => ", " \"", " is ", " was ", ": Bearer ", " ")
    other = one("name", "commit ", "md5 ", "md5: ", "sha256 checksum: ", "digest = ", "hash=", "uuid ", "order ", "build ", "revision ", "version = \"", "href=\"", "http://example.com/", "isbn ", "")
    none = one("name", "", "the ", "see ", "(", "\"", "id = ", "name: \"")
    kind = F.col("n") % 4  # secrets; digests; what is made of words, after a secret name and elsewhere
    plain = F.col("n")  # of the word-made rows after a secret name some are secrets of a form of their own
    value = F.when(kind == 0, secret).when(plain == 2, secret).when(plain == 6, one("b", known, known, block)).when(plain == 10, phrase)
    value = value.when(plain == 14, secret).when(kind == 1, digest).otherwise(common)
    is_secret = (kind == 0) | plain.isin(2, 6, 10, 14)
    url = one("url", "postgres://", "https://", "mysql://", "amqp://", "ftp://")
    lead = F.when(plain == 6, none).when(plain == 10, F.concat(named, one("join", " = \"", "=\"", ": \"", " = '", ": '")))
    lead = lead.when(plain == 14, F.concat(url, F.lower(word("m")), F.lit(":")))
    lead = lead.when(is_secret | (kind == 2), F.concat(named, joined)).when(kind == 1, other).otherwise(none)
    close = F.when(lead.endswith("\""), "\"").when(lead.endswith("'"), "'").when(plain == 14, F.concat(F.lit("@"), F.lower(word("o")))).otherwise("")
    made = rows.select(
        value.alias("value"),
        F.concat(word("i"), F.lit(" "), word("j"), F.lit(" "), lead).alias("before"),
        F.concat(close, one("end", " ", ", ", "; ", ")\n", "\n", ". "), word("k"), F.lit(" "), word("l")).alias("after"),
        one("path", "src", "lib", "app/config", "docs/examples", "tests", "samples").alias("path"),
        is_secret.cast("int").alias("label"),
    )
    return made.where(F.length("value") >= VALUE)


def train(labelled: DataFrame, words: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> RandomForestClassificationModel | None:
    """A forest from labelled findings; the same for the same findings. None without findings of both labels."""
    rows = with_coverage(shape_features(labelled), words).select(*FEATURES, F.col("label").cast("double").alias("label"))
    rows = cut(rows.repartition(1).sortWithinPartitions("label", *FEATURES))  # bounded; one order whatever the cluster
    if rows.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)
    return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))


def judged(found: DataFrame, words: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """Add score (share of the forest for a secret) and is_secret (0.5 or more). Without a forest every candidate stays."""
    if model is None:
        return found.withColumns({"score": F.lit(1.0), "is_secret": F.lit(True)})
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_coverage(shape_features(found), words))
    rows = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return rows.select(*found.columns, "score", (F.col("score") >= 0.5).alias("is_secret"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", labelled: DataFrame | None = None) -> DataFrame:
    """Every candidate with the forest's judgement: row_key, pos, doc_id, path, value, before, after, start, stop, score, is_secret."""
    found = cut(candidates(docs, id_col, text_col, path_col))
    known = cut(labelled if labelled is not None else labelled_findings(docs, id_col, text_col))
    runs = found.select("value").union(known.select("value"))
    wanted = runs.select(F.explode(F.split(F.lower("value"), "[^a-z]+")).alias("word")).where(F.length("word") >= 4).distinct()
    words = cut(dictionary(docs, text_col).join(wanted, "word", "left_semi"))
    model = train(known, words)
    return judged(found, words, model).withColumn("stop", F.col("start") + F.length("value"))


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """doc_id, start, stop, value_sha256, score, is_secret of every candidate."""
    return scan(docs, id_col, text_col, path_col).select(
        "doc_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"),
        F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"), "is_secret",
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", mask: str = MASK) -> DataFrame:
    """The input with each secret in its texts replaced by the mask."""
    key, flags, hits, gaps = fresh(docs, "s_key", "s_flags", "s_hits", "s_gaps")
    marks = scan(docs, id_col, text_col, path_col).groupBy(F.col("row_key").alias(key)).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "is_secret"))), lambda x: x["is_secret"]).alias(flags)
    )
    marks = cut(marks.where(F.array_contains(flags, True)))
    has = F.coalesce(F.col(text_col).rlike(CANDIDATE), F.lit(False))
    shown = F.transform(
        F.col(gaps),
        lambda g, i: F.concat(g, F.when(F.get(F.col(flags), i), F.lit(mask)).otherwise(F.coalesce(F.get(F.col(hits), i), F.lit("")))),
    )
    clean = docs.where(~has)
    marked = docs.where(has).withColumn(key, _row_key(id_col, path_col, text_col)).join(marks, key, "left")
    marked = marked.withColumns({
        hits: F.regexp_extract_all(F.col(text_col), F.lit(CANDIDATE), F.lit(0)),
        gaps: F.split(F.col(text_col), CANDIDATE, -1),
    })
    marked = marked.withColumn(text_col, F.when(F.col(flags).isNull(), F.col(text_col)).otherwise(F.array_join(shown, "")))
    return clean.unionByName(marked.select(*docs.columns))
