"""Secret scanning: a wide net of candidates, and a random forest that takes the false positives out.

A candidate is a run of at least 16 key characters with a digit or a change to upper case inside, or such a run of 8 or
more that is assigned to something. The forest sees its length, how its characters follow each other, how much of it
dictionary words cover, the path it was found under and the words around it, and learns from labelled findings: reviewed
ones, or else keys and harmless strings that are planted between words of the texts themselves. What is planted is
known to be a secret or not from how it was made, in places that say so and in others that do not; no label is read off a
feature. All steps are built-in functions and Spark ML.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

#: Places in texts between which findings are planted (those whose hashes are lowest), at most; reviewed findings that the
#: forest is fitted on, of each kind, at most; texts that hold a word of the dictionary, at least.
PLACES, REVIEWED, MIN_TEXTS = 2_000, 20_000, 3
TREES, TREE_DEPTH, SEED, MIN_PROBABILITY = 40, 8, 7, 0.5
_SPACES = r"[\x20\x09-\x0D]+"
_RUN, _KEY = r"[A-Za-z0-9+/_-]{8,}={0,2}", r"[A-Za-z0-9+/_-]{16,}"
_MIXED = r"[0-9]|[a-z][A-Z]"
_ASSIGNED = r"(=|:|=>)\s*[\"'`]?$"

#: Words that name secrets, words that name harmless digests and numbers, words of harmless paths, and how
#: keys of well-known services begin.
SECRET_WORDS = ("token", "secret", "key", "apikey", "password", "passwd", "pwd", "auth", "authorization", "bearer", "credential", "private", "access")
HARMLESS_WORDS = ("sha", "sha1", "sha256", "md5", "commit", "checksum", "digest", "hash", "uuid", "guid", "revision", "version", "build", "etag", "integrity", "base64", "example", "sample", "dummy", "placeholder", "your")
HARMLESS_PATHS = ("test", "tests", "example", "examples", "sample", "mock", "fixture", "fixtures", "lock", "vendor", "docs")
KEY_STARTS = ("AKIA", "ghp_", "sk-", "xoxb-", "AIza", "glpat-")

FEATURES = (
    "length", "digit_share", "upper_share", "lower_share", "distinct_share", "hex_only", "digit_letter_changes", "case_changes",
    "repeats", "vowel_consonant_changes", "separator_share", "dictionary_share", "known_start", "secret_word_before", "harmless_word_before",
    "assigned", "quoted", "before_at", "in_url_or_path", "harmless_path",
)


def _any_word(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike(r"(?i)(^|[^a-z0-9])(" + "|".join(words) + r")s?([^a-z0-9]|$)")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """``id, hash, path, word, part, key, before, behind``: every candidate, with a hash of its text, its word's number in the
    text, its number in the word, up to three words before it with what precedes it in its own word, and what comes behind."""
    path = scratch.column(docs, path_col).cast("string") if path_col else F.lit(None).cast("string")
    rows = docs.select(scratch.column(docs, id_col).cast("long").alias("id"), path.alias("path"), scratch.column(docs, text_col).cast("string").alias("text"))
    rows = rows.where(F.col("text").rlike(_KEY) | F.col("text").rlike(r"[=:]>?\s*[\"'`]?[A-Za-z0-9+/_-]{8}"))
    rows = rows.select("id", F.xxhash64("text").alias("hash"), "path", F.split("text", _SPACES).alias("words"))
    word = lambda i: F.when(i >= 0, F.get(F.col("words"), i))
    short = lambda w, i: w.rlike(_RUN) & (w.rlike(r"[=:]") | F.coalesce(word(i - 1).rlike(r"[=:]>?$"), F.lit(False)))
    here = F.filter(F.transform("words", lambda w, i: F.when(w.rlike(_MIXED) & (w.rlike(_KEY) | short(w, i)), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("here", here)
    found = F.transform(
        "here",
        lambda i: F.struct(i.alias("word"), word(i).alias("own"), F.concat_ws(" ", word(i - 3), word(i - 2), word(i - 1)).alias("left"), F.coalesce(word(i + 1), F.lit("")).alias("right")),
    )
    rows = rows.select("id", "hash", "path", F.explode(found).alias("f")).select("id", "hash", "path", "f.*")
    # A word is a gap, a run, a gap, a run, and so on to a last gap: a run's place is where those before it end, not where its text first stands.
    rows = rows.select("*", F.split("own", _RUN).alias("gaps"), F.regexp_extract_all("own", F.lit(_RUN), F.lit(0)).alias("runs"))
    rows = rows.select("*", F.posexplode("runs").alias("part", "key")).where(F.col("key").rlike(_MIXED))
    joined = lambda name, n: F.length(F.concat_ws("", F.slice(name, F.lit(1), n)))
    rows = rows.withColumn("at", joined("gaps", F.col("part") + 1) + joined("runs", F.col("part")))
    rows = rows.withColumn("before", F.concat_ws(" ", "left", F.substring("own", F.lit(1), F.col("at"))))
    rows = rows.where((F.length("key") >= 16) | F.col("before").rlike(_ASSIGNED))
    behind = F.concat_ws(" ", F.expr("substring(own, at + length(key) + 1)"), "right")
    return rows.select("id", "hash", "path", "word", "part", "key", "before", behind.alias("behind"))


def dictionary(docs: DataFrame, text_col: str = "text", min_texts: int = MIN_TEXTS) -> DataFrame:
    """``entry``: the words of 3 to 12 letters a to z that ``min_texts`` texts or more hold, counted over all texts."""
    words = F.filter(F.split(F.lower(scratch.column(docs, text_col).cast("string")), r"[^a-z]+"), lambda w: F.length(w).between(3, 12))
    counts = docs.select(F.explode(F.array_distinct(words)).alias("entry")).groupBy("entry").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= min_texts).select("entry")


def with_features(found: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds FEATURES to findings (path, key, before, behind). A key falls into runs of letters of one kind, which are looked up
    among ``entries``, so the work is in proportion to its length."""
    key, n = F.col("key"), F.length("key")
    count = lambda pattern: F.regexp_count("key", F.lit(pattern)).cast("double")
    changes = lambda a, b: (count(f"{a}(?={b})") + count(f"{b}(?={a})")) / (n - 1)
    runs = F.transform(F.regexp_extract_all("key", F.lit("[A-Z]?[a-z]{2,}|[A-Z]{3,}"), F.lit(0)), F.lower)
    pieces = found.select("key").distinct().select("key", F.explode(F.filter(runs, lambda w: F.length(w).between(3, 12))).alias("entry"))
    covered = pieces.join(entries, "entry").groupBy("key").agg(F.sum(F.length("entry")).alias("covered"))
    before, path = F.col("before"), F.col("path")
    own = {
        "length": n.cast("double"),
        "digit_share": count("[0-9]") / n,
        "upper_share": count("[A-Z]") / n,
        "lower_share": count("[a-z]") / n,
        "distinct_share": F.size(F.array_distinct(F.split("key", ""))) / n,
        "hex_only": key.rlike("^([0-9a-f]+|[0-9A-F]+)$"),
        "digit_letter_changes": changes("[0-9]", "[A-Za-z]"),
        "case_changes": changes("[a-z]", "[A-Z]"),
        "repeats": count(r"(.)(?=\1)") / (n - 1),
        "vowel_consonant_changes": changes("[aeiouAEIOU]", "[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z]"),
        "separator_share": count("[/_+-]") / n,
        "dictionary_share": F.coalesce(F.col("covered") / n, F.lit(0.0)),
        "known_start": key.rlike("^(" + "|".join(KEY_STARTS) + ")"),
        "secret_word_before": _any_word(before, SECRET_WORDS),
        "harmless_word_before": _any_word(before, HARMLESS_WORDS) | _any_word(key, HARMLESS_WORDS),
        "assigned": before.rlike(_ASSIGNED),
        "quoted": before.rlike(r"[\"'`]$") & F.col("behind").rlike(r"^[\"'`]"),
        "before_at": F.col("behind").startswith("@"),
        "in_url_or_path": before.rlike(r"[/.@][^\x20]*$"),
        "harmless_path": F.coalesce(_any_word(path, HARMLESS_PATHS), F.lit(False)),
    }
    return found.join(covered, "key", "left").withColumns({k: v.cast("double") for k, v in own.items()}).drop("covered")


def planted(docs: DataFrame, text_col: str = "text", places: int = PLACES) -> DataFrame:
    """Labelled findings where nobody has reviewed any: ``path, key, before, behind, label``, of at most ``places`` texts.

    Each text gives a place between four of its words, where secrets and harmless strings are put in turn. All draws come
    from the text's hash.
    """
    text = scratch.column(docs, text_col).cast("string")
    rows = docs.select(F.split(text, _SPACES).alias("words"), F.xxhash64(text).alias("hash")).where(F.size("words") > 4)
    at = F.pmod("hash", F.size("words") - 4).cast("int") + 1
    rows = rows.select("hash", F.slice("words", at, F.lit(4)).alias("here"), F.slice("words", at, F.lit(64)).alias("near"))
    # About eight times the places are sorted, each text once, and of each no more than some words.
    share = min(1.0, 8 * places / max(1, docs.count()))
    rows = rows.where(F.pmod("hash", F.lit(1 << 30)) < int(share * (1 << 30))).dropDuplicates(["hash"]).orderBy("hash").limit(places)
    draw = lambda salt, n: F.pmod(F.xxhash64("hash", F.lit(salt)), F.lit(n)).cast("int")
    pick = lambda salt, *values: F.get(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), draw(salt, len(values)))
    plain = F.filter(F.transform("near", lambda w: F.lower(w)), lambda w: w.rlike("^[a-z]{3,12}$"))
    plain = F.concat(plain, F.array(*map(F.lit, ("value", "item", "name", "list"))))
    rows = rows.select("hash", F.slice("here", 1, 3).alias("left"), F.element_at("here", 4).alias("right"), plain.alias("plain"))
    rows = rows.withColumn("left", F.array_join("left", " "))

    digits = lambda salt: F.sha2(F.concat_ws("-", F.col("hash").cast("string"), F.lit(salt)), 512)  # noqa: E731  128 hex digits
    cut = lambda value, salt, low, high: F.substring(value, F.lit(1), F.lit(low) + draw(salt, high - low + 1))
    coded = lambda salt: F.base64(F.unhex(digits(salt)))
    letters = lambda salt: F.translate(coded(salt), "+/=", "aB7")
    word = lambda i: F.element_at("plain", F.pmod(F.xxhash64("hash", F.lit(f"word{i}")), F.size("plain")).cast("int") + 1)
    spaced = lambda *parts: F.concat(F.col("left"), F.lit(" "), *(p if isinstance(p, Column) else F.lit(p) for p in parts))
    hexes = lambda salt: F.substring(digits(salt), F.lit(1), pick(f"{salt}n", 32, 40, 64))
    secret_name = pick("name", "token", "api_key", "SECRET", "password", "access-token", "client_secret", "auth_token", "private_key", "apikey", "secretKey")
    other_name = F.concat(word(5), pick("o", "", "_id", "_value", "Data"))
    number = F.translate(F.substring(digits("digits"), F.lit(1), F.lit(16) + draw("dn", 6)), "abcdef", "012345")
    start = F.concat(F.lit("AKIA"), F.translate(F.upper(F.substring(digits("akia"), 1, 16)), "0189", "QRST"))
    # What several findings share is written as columns: as one expression, it makes methods of over 64 KB, which the driver compiles in vain.
    shared = {
        "secret_name": secret_name,
        "other_name": other_name,
        "any_name": pick("kn", secret_name, other_name),
        "sign": pick("sign", " = ", "=", ": ", ":", " => "),
        "quote": pick("quote", '"', "'", "", '"'),
        "end": pick("end", "", ",", ";"),
        "camel": F.concat(word(1), F.initcap(word(2)), F.initcap(word(3)), F.initcap(word(4)), pick("cd", "", "2", "", "V1")),
        "snake": F.regexp_replace(F.concat_ws("_", word(1), word(2), word(3), pick("sd", "v2", "01", "2024", "x86")), F.lit("_"), pick("cs", "_", "-")),
        "route": F.concat(F.concat_ws("/", word(1), word(2), word(3)), F.lit("/"), draw("route", 900000).cast("string")),
        "number": number,
        "uuid": F.regexp_replace(F.substring(digits("uuid"), 1, 32), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"),
        "dummy": pick("dummy", F.concat(F.lit("your-"), word(1), F.lit("-key-here1")), F.lit("xxxxxxxxxxxxxxxxxxxx1"), F.lit("EXAMPLE0123456789KEY"), F.lit("1234567890abcdef1234"), F.lit("00000000-0000-0000-0000-000000000000"), F.concat(F.lit("insert_"), word(2), F.lit("_token_2"))),
        "known": pick("known", start, F.concat(F.lit("ghp_"), F.substring(letters("ghp"), 1, 36)), F.concat(F.lit("sk-"), cut(letters("sk"), "skn", 32, 48)), F.concat(F.lit("xoxb-"), number, F.lit("-"), F.substring(letters("xo"), 1, 24)), F.concat(F.lit("glpat-"), F.substring(letters("gl"), 1, 20))),
        "source": F.concat(F.lit("src"), draw("src", 40).cast("string")),
        "test_path": pick("path", "tests/fixtures/a.py", "docs/example.md", "vendor/x.lock"),
    }
    rows = scratch.write(rows.withColumns({f"word{i}": word(i) for i in (1, 2, 4)} | shared), "places")
    secret_name, other_name, any_name, sign, quote, end, camel, snake, route, number, uuid, dummy, known, source, test_path = (F.col(c) for c in shared)
    word = lambda i: F.col(f"word{i}")
    assigned = lambda name: (spaced(name, sign, quote), F.concat(quote, end, F.lit(" "), F.col("right")))
    bare = (spaced(""), F.concat(F.lit(" "), F.col("right")))
    harmless_word = pick("harmless", "commit ", "sha256: ", "md5 = ", "sha1:", "checksum ", "ETag: \"", "revision ", "digest=", "build ")
    secret = [
        (hexes("s1"), *assigned(secret_name), source),
        (cut(digits("s12"), "s12n", 10, 48), *assigned(secret_name), source),
        (cut(coded("s2"), "s2n", 24, 64), *assigned(secret_name), source),
        (cut(letters("s3"), "s3n", 20, 40), *assigned(secret_name), source),
        (cut(letters("s4"), "s4n", 24, 60), *assigned(other_name), source),
        (cut(letters("s5"), "s5n", 22, 60), *bare, source),
        (known, *assigned(any_name), source),
        (known, *bare, source),
        (cut(pick("s8", letters("s8"), digits("s8")), "s8n", 24, 60), spaced(pick("b", "Authorization: Bearer ", "Bearer ", "authorization: token ")), bare[1], source),
        (cut(letters("s9"), "s9n", 9, 20), spaced("https://", word(1), ":"), F.concat(F.lit("@"), word(2), F.lit(".com/ "), F.col("right")), source),
        (cut(letters("s10"), "s10n", 9, 15), *assigned(pick("short", "password", "pwd", "passwd", "secret")), source),
        (F.substring(coded("s11"), 1, 64), spaced(F.substring(coded("s11b"), 1, 64), " "), bare[1], source),
    ]
    harmless = [
        (hexes("h1"), spaced(harmless_word), bare[1], source),
        (hexes("h2"), *bare, source),
        (uuid, *bare, source),
        (uuid, *assigned(other_name), source),
        (camel, *assigned(pick("h5", secret_name, other_name)), source),
        (camel, *bare, source),
        (snake, *assigned(pick("h7", secret_name, other_name)), source),
        (route, spaced(pick("h8", "", "https://", word(4))), bare[1], source),
        (number, *assigned(pick("h9", other_name, F.lit("timestamp"), F.lit("order"))), source),
        (number, *bare, source),
        (dummy, *assigned(secret_name), source),
        (cut(letters("h12"), "h12n", 20, 40), *assigned(secret_name), test_path),
        (hexes("h13"), *assigned(secret_name), test_path),
        (coded("h14"), spaced("data:image/png;base64,"), bare[1], source),
        (hexes("h15"), spaced(word(1), "/blob/"), F.concat(F.lit("/"), word(2), F.lit(" "), F.col("right")), source),
    ]
    made = [F.struct(k.alias("key"), b.alias("before"), a.alias("behind"), p.alias("path"), F.lit(float(label)).alias("label")) for label, rows_ in ((1, secret), (0, harmless)) for k, b, a, p in rows_]
    out = rows.select(F.explode(F.array(*made)).alias("m")).select("m.*")
    return out.where(F.col("key").rlike(_MIXED) & (F.length("key") >= 8))


def fit_forest(labelled: DataFrame):
    """The forest over FEATURES of labelled findings; None without any. If all are of one kind, so is every candidate."""
    sample = scratch.write(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(labelled).select("label", "features").coalesce(1), "findings")
    if not sample.limit(1).count():
        return None
    return RandomForestClassifier(numTrees=TREES, maxDepth=TREE_DEPTH, seed=SEED).fit(sample)


def _scored(docs: DataFrame, findings: DataFrame | None, id_col: str, text_col: str, path_col: str | None) -> DataFrame:
    found = scratch.write(candidates(docs, id_col, text_col, path_col), "candidates")
    entries = scratch.write(dictionary(docs, text_col), "dictionary")
    if findings is None:
        labelled = planted(docs, text_col)
    else:  # each kind is bounded by itself, so secrets are learned from however rare they are
        order = F.xxhash64("key", "before", "behind", "path")
        kind = lambda label: findings.where(F.col("label") == label).orderBy(order, "key", "before").limit(REVIEWED)
        labelled = kind(1).unionByName(kind(0)).select("path", "key", "before", "behind", F.col("label").cast("double"))
    model = fit_forest(with_features(scratch.write(labelled, "labelled"), entries))
    rows = with_features(found, entries)
    if model is None:
        return rows.select("id", "hash", "word", "part", "key", F.lit(None).cast("double").alias("probability")).where("false")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("id", "hash", "word", "part", "key", "features")
    scored = model.transform(rows).withColumn("probability", F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0)))
    return scored.where(F.col("probability") >= MIN_PROBABILITY).select("id", "hash", "word", "part", "key", F.round("probability", 6).alias("probability"))


def scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """The candidates that the forest takes for secrets: ``id_col, word, part, secret, probability``.

    ``findings`` are reviewed ones (``path, key, before, behind, label`` 0 or 1, as :func:`candidates` has them); without
    them the forest learns from :func:`planted`. Null and empty texts have no candidates, null paths no harmless word. Every
    candidate of a very long text is answered, and a very long candidate like any other. Repeated rows are each scanned;
    null ids are kept. Other columns, whatever their names, are ignored. An empty table gives an empty result.
    """
    return _scored(docs, findings, id_col, text_col, path_col).select(F.col("id").alias(id_col), "word", "part", F.col("key").alias("secret"), "probability")


def redact(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", mark: str = "[secret]") -> DataFrame:
    """The same rows and columns with every secret that :func:`scan` finds in a text replaced by ``mark``, wherever it stands there.

    Secrets are gathered by id and text, so rows without an id, or with the same one, do not share theirs. Texts without a
    secret, null and empty ones among them, stay as they are. Any column names will do.
    """
    found = _scored(docs, findings, id_col, text_col, path_col)
    own = found.groupBy("id", "hash").agg(F.array_sort(F.collect_set("key"), lambda a, b: F.length(b) - F.length(a)).alias("keys"))
    own = own.select(F.col("id").alias("own_id"), F.col("hash").alias("own_hash"), "keys")
    text = scratch.column(docs, text_col).cast("string")
    rows = docs.select(scratch.column(docs, id_col).cast("long").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"), scratch.boxed(docs).alias("row"))
    joined = rows.join(own, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("hash") == F.col("own_hash")), "left")
    clean = F.when(F.col("keys").isNull(), F.col("text")).otherwise(F.aggregate("keys", F.col("text"), lambda t, key: F.replace(t, key, F.lit(mark))))
    return joined.select(*((clean if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns))
