"""Language of web pages from text, declared markup language, address suffix and host priors."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablewright.llm.frames import quoted, small_or_not, stored
from tablewright.llm.mainline import ATTRIBUTE, BLOCK, TOKEN, main_text
from tablewright.llm.textblocks import mix

# Labelled texts that a fit takes (about, by hash), and hash buckets of the character trigrams.
SAMPLE_ROWS, GRAM_BUCKETS = 20_000, 1 << 15
# Trigrams of a text that count in full; neighbours depend on each other, so more add no certainty.
FULL_GRAMS = 60
# Weight of the level above in the prior of a domain and of a host, and pseudo counts of the tables of evidence.
DOMAIN_WEIGHT, HOST_WEIGHT, EVIDENCE_WEIGHT = 20.0, 10.0, 1.0
# Rows of one host that a task of the last join takes.
SALT_ROWS = 500

_CODE = re.compile(r"\s*([A-Za-z]{2,3})(?![A-Za-z])")


def declared_language(html: str) -> str:
    """Language code of the html element, else of a content-language in the head; empty if there is none."""
    found = ""
    for token in TOKEN.finditer(html):
        name = (token["name"] or "").lower()
        if token["close"] or name not in ("html", "meta"):
            if name in BLOCK and name != "head":
                break
            continue
        values = {}
        for kind, *value in ATTRIBUTE.findall(token["attributes"]):
            values.setdefault(kind.lower(), "".join(value))
        if name == "html":
            codes = [_CODE.match(values.get(kind, "")) for kind in ("lang", "xml:lang")]
            code = next((c for c in codes if c), None)
            if code:
                return code[1].lower()
        elif values.get("http-equiv", "").strip().lower() == "content-language" and not found:
            code = _CODE.match(values.get("content", ""))
            found = code[1].lower() if code else ""
    return found


def gram_buckets(text: str) -> np.ndarray:
    """Hash buckets of the character trigrams of lower-cased words, a space on either side."""
    words = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    points = np.frombuffer(words.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(points) < 4:
        return np.zeros(0, dtype=np.int64)
    code = points[:-2] * np.uint64(1 << 42) + points[1:-1] * np.uint64(1 << 21) + points[2:]
    return (mix(code) % np.uint64(GRAM_BUCKETS)).astype(np.int64)


@dataclass
class LanguageModel:
    """Languages in order and, for each, the logarithm of the probability of each trigram bucket."""
    languages: list[str]
    weights: np.ndarray


def fit_languages(texts: DataFrame, text: str = "text", language: str = "lang", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Trigram probabilities of every language in at most about `sample_rows` labelled texts.

    Null labels and texts don't count. Counts are summed by language and bucket; only these sums reach the driver,
    a language takes 256 KB.
    """
    known = texts.select(quoted(key).alias("key"), quoted(language).alias("language"), quoted(text).alias("text")).dropna(subset=["language", "text"])
    total = known.count()
    if total > sample_rows:
        known = known.filter(F.pmod(F.xxhash64("key", F.lit("language")), F.lit(1 << 30)) < int((1 << 30) * sample_rows / total))
    names = [r[0] for r in known.groupBy("language").count().orderBy(F.desc("count"), "language").collect()]
    place = {name: i for i, name in enumerate(names)}

    def run(batches):
        counts = np.zeros((len(names), GRAM_BUCKETS), dtype=np.int64)
        for batch in batches:
            for name, value in zip(batch.column("language").to_pylist(), batch.column("text").to_pylist()):
                if name in place:
                    counts[place[name]] += np.bincount(gram_buckets(value), minlength=GRAM_BUCKETS)
        rows, buckets = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(buckets.astype(np.int32)), pa.array(counts[rows, buckets])], ["language", "bucket", "n"])

    sums = known.select("language", "text").mapInArrow(run, "language int, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    counts = np.full((len(names), GRAM_BUCKETS), 0.5)
    for row in sums.toLocalIterator():
        counts[row["language"], row["bucket"]] += row["n"]
    return LanguageModel(names, np.log(counts / counts.sum(axis=1, keepdims=True)) if names else counts)


def _address(url: str | None) -> tuple[str, str, str]:
    """Host, its last two labels, and its last label."""
    try:
        host = (urlsplit(url or "").hostname or "").rstrip(".").lower()
    except ValueError:
        host = ""
    labels = host.split(".")
    return host, ".".join(labels[-2:]), labels[-1]


def page_evidence(df: DataFrame, model: LanguageModel, key: str, url: str, html: str) -> DataFrame:
    """key, host, domain, suffix, declared, likelihoods (logarithm for each language) and shares (from the text alone)."""
    languages = len(model.languages)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            values, addresses, declared = np.zeros((n, languages)), [], []
            for i, (page, address) in enumerate(zip(batch.column("html").to_pylist(), batch.column("url").to_pylist())):
                grams = gram_buckets(main_text(page))
                if len(grams):
                    values[i] = model.weights[:, grams].sum(axis=1) * min(1.0, FULL_GRAMS / len(grams))
                declared.append(declared_language(page or ""))
                addresses.append(_address(address))
            shares = np.exp(values - values.max(axis=1, keepdims=True)) if languages else values
            shares = shares / shares.sum(axis=1, keepdims=True) if languages else shares
            ends = pa.array(np.arange(n + 1, dtype=np.int32) * languages)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *(pa.array([a[i] for a in addresses], pa.string()) for i in range(3)), pa.array(declared, pa.string()),
                 pa.ListArray.from_arrays(ends, pa.array(values.ravel())), pa.ListArray.from_arrays(ends, pa.array(shares.ravel()))],
                ["key", "host", "domain", "suffix", "declared", "likelihoods", "shares"])

    rows = df.select(quoted(key).alias("key"), quoted(url).cast("string").alias("url"), quoted(html).cast("string").alias("html"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, host string, domain string, suffix string, declared string, likelihoods array<double>, shares array<double>")


def identify_languages(df: DataFrame, model: LanguageModel, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Key, language, probability, text_language, declared and suffix of every page.

    The posterior is, up to a factor, the likelihood of the main text's trigrams times that of the declared language
    and of the address suffix times the prior of the host. Tables of evidence are summed over all pages with the
    languages' shares by text: P(declared | language), P(suffix | language); a host's prior is its own sums smoothed
    by its domain's, those by all pages'; the page's own share is taken out of them. A page without text,
    declaration or address has no such evidence; without any labelled text the language is null. Rows that
    repeat count as pages of their own. A hot host is summed before the shuffle and spread over tasks in the join.
    """
    if not model.languages:
        return df.select(quoted(key), F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("probability"),
                         F.lit(None).cast("string").alias("text_language"), F.lit("").alias("declared"), F.lit("").alias("suffix"))
    size = len(model.languages)
    pages = stored(page_evidence(df, model, key, url, html), "evidence")
    # shares as whole numbers, so that sums don't depend on their order
    sums = [F.sum(F.round(F.get("shares", F.lit(i)) * 1_000_000).cast("long")).alias(f"s{i}") for i in range(size)]
    every = [f"s{i}" for i in range(size)]
    merged = [F.sum(c).alias(c) for c in every]

    def array():
        return F.transform(F.array(*every), lambda s: s / 1_000_000)

    hosts = stored(pages.groupBy("host", "domain").agg(F.count("*").alias("n"), *sums), "hosts")
    domains = hosts.groupBy("domain").agg(*merged).select("domain", array().alias("of_domain"))
    total = hosts.agg(*merged).select(array().alias("of_all"))

    def likelihoods(name):
        table = pages.filter(F.col(name) != "").groupBy(name).agg(*sums).select(name, array().alias("own"))
        table = stored(table, name)
        # languages' totals over the values, one row
        overall = table.select(F.posexplode("own").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).agg(
            F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("sums"), F.lit(1).alias("one"))
        values = max(1, table.count())
        return small_or_not(stored(table.join(F.broadcast(overall)).select(F.col(name).alias(f"{name}_value"), F.zip_with(
            "own", "sums", lambda a, b: F.log((a + EVIDENCE_WEIGHT / values) / (b + EVIDENCE_WEIGHT))).alias(f"by_{name}")), name))

    priors = hosts.select("host", "domain", "n", array().alias("of_host")).join(domains, "domain").join(F.broadcast(total))
    parts = F.sequence(F.lit(0), F.ceil(F.col("n") / SALT_ROWS).cast("int") - 1)
    priors = priors.withColumn("parts", F.size(parts)).withColumn("salt", F.explode(parts))
    counts = small_or_not(stored(hosts.filter(F.col("n") > SALT_ROWS).select("host", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("several")), "salts"))
    salted = pages.join(counts, "host", "left").withColumn("salt", F.pmod(F.xxhash64("key", "likelihoods"), F.coalesce("several", F.lit(1))).cast("int"))
    joined = (salted.join(priors.drop("domain", "n", "parts"), ["host", "salt"])
              .join(likelihoods("declared"), F.col("declared") == F.col("declared_value"), "left")
              .join(likelihoods("suffix"), F.col("suffix") == F.col("suffix_value"), "left"))

    def smoothed(own, above, weight):
        """Shares of a level: its sums without the page's own, and `weight` pages like the level above."""
        rest = F.zip_with(own, "shares", lambda a, b: F.greatest(F.lit(0.0), a - b))
        whole = F.aggregate(rest, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(rest, above, lambda a, b: (a + weight * b) / (whole + weight))

    joined = joined.withColumn("p0", smoothed("of_all", F.array(*[F.lit(1.0 / size)] * size), 1.0))
    joined = joined.withColumn("p1", smoothed("of_domain", "p0", DOMAIN_WEIGHT)).withColumn("p2", smoothed("of_host", "p1", HOST_WEIGHT))
    nothing = F.array(*[F.lit(0.0)] * size)
    score = F.transform("likelihoods", lambda x, i: x + F.log(F.get("p2", i)) + F.get(F.coalesce("by_declared", nothing), i) + F.get(F.coalesce("by_suffix", nothing), i))
    joined = joined.withColumn("score", score).withColumn("powers", F.transform("score", lambda x: F.exp(x - F.array_max("score"))))
    names = F.array(*map(F.lit, model.languages))
    best = F.get(names, F.array_position("score", F.array_max("score")).cast("int") - 1)
    by_text = F.when(F.array_max("shares") > F.array_min("shares"), F.get(names, F.array_position("shares", F.array_max("shares")).cast("int") - 1))
    return joined.select(F.col("key").alias(key), best.alias("language"), F.round(1 / F.aggregate("powers", F.lit(0.0), lambda a, b: a + b), 6).alias("probability"),
                         by_text.alias("text_language"), "declared", "suffix")
