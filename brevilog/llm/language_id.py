"""Language identification of web pages by Bayesian fusion of evidence.

    log P(lang | page) = log P(text | lang) * pull + log P(declared | lang) + log P(suffix | lang) + log P(lang | host)

* Text: byte trigrams of the words of the page (markup cut out, A-Z lower-cased), hashed to ``CELLS`` cells; the
  likelihoods are counts by grouped aggregation over documents with a known language. ``pull`` keeps the
  many dependent trigrams of a long page from drowning everything else.
* Declared markup language and address suffix (the first two-letter part of the path, else the last part of the host):
  how often they go with a language is counted over all pages with text, by the language that the text alone gives. Each
  value has its own counts, however rare; those of a value lean on how often each language occurs, with ``SMOOTH`` pseudo-counts.
* Host: prior of a host, smoothed towards its registered domain, that towards its top-level domain, and that towards
  the whole table, with ``SMOOTH`` pseudo-counts a level. Each level is a grouped aggregate.

The text model has CELLS rows for each language and is collected; values of declarations, suffixes and hosts
are never collected, what is known of them is joined. Pages without text vote for no language.

Cases: null or empty html has no text, so the other evidence decides; a null url has no host and takes the prior of the whole table; a page without
any evidence gets the most frequent language; ties go to the first language by name; without training rows the result is null;
repeated rows count as often as they occur; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, mix, pieces, rows_of, stash

CELLS = 1 << 16
SMOOTH = 20.0
PULL_BYTES = 300   # a page's text weighs at most as much as so many trigrams
MAX_LANGS = 200

_TAGS = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>?")
_LANG = re.compile(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})\b")
_ENTITY = re.compile(r"&[#\w]{1,12};")


def visible(html: str) -> str:
    """Text of a page, roughly: markup and character references become blanks."""
    return _ENTITY.sub(" ", _TAGS.sub(" ", html))


def declared(html: str) -> str:
    found = _LANG.search(html)
    return found.group(1).lower() if found else ""


def cells(data: np.ndarray) -> np.ndarray:
    """Cells of the trigrams of bytes that are no digits, marks or white space of ASCII (those count as one blank)."""
    data = LOWER[data]
    word = (data >= 0x80) | (data >= 97) & (data <= 122)
    data = np.where(word, data, 0x20)
    data = data[np.append(True, word[1:] | word[:-1])] if len(data) else data
    b = data.astype(np.uint64)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    return (mix(b[:-2] | b[1:-1] << np.uint64(8) | b[2:] << np.uint64(16)) & np.uint64(CELLS - 1)).astype(np.int64)


def _cell_counts(langs: list[str]):
    """Counts by language and cell of a part of the rows (text, lang)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), CELLS), np.int64)
        for b in batches:
            at = np.array([langs.index(x) for x in b.column("lang").to_pylist()])
            for lo, hi, data, offs in pieces(b.column("text")):
                for k in np.unique(at[lo:hi]):
                    flags = np.repeat(at[lo:hi] == k, np.diff(offs))
                    total[k] += np.bincount(cells(data[flags]), minlength=CELLS)
        k, c = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c), pa.array(total[k, c])], names=["k", "cell", "n"])
    return run


def text_model(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and the log-likelihood of each cell. Collects a row for each language and cell."""
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).alias("lang"))
    langs = sorted(r[0] for r in rows.select("lang").distinct().limit(MAX_LANGS + 1).collect())
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    counts = np.full((len(langs), CELLS), 0.1)
    for k, c, n in rows.mapInArrow(_cell_counts(langs), "k long, cell long, n long").groupBy("k", "cell").agg(F.sum("n")).toLocalIterator():
        counts[k, c] += n
    return langs, np.log(counts / counts.sum(1, keepdims=True))


def _evidence(held, n_langs: int):
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("said", pa.string()), ("has_text", pa.bool_()), ("text_logs", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                html = part.column("html").to_pylist()
                said = [declared(h) for h in html]
                logs, has_text = [], []
                for h in html:
                    c = cells(np.frombuffer(visible(h).encode(), np.uint8))
                    has_text.append(len(c) > 0)
                    s = held.value[:, c].sum(1) * min(1.0, PULL_BYTES / max(len(c), 1)) if len(c) else np.zeros(n_langs)
                    logs.append(s - s.max() if len(s) else s)
                yield rows_of(out, part.column("page_id"), part.column("url").cast(pa.string()), said, has_text, pa.array(logs, pa.list_(pa.float64())))
    return run


def url_parts(url: Column) -> dict[str, Column]:
    """Host, registered domain (last two parts), top-level domain, and language suffix of an address."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    parts = F.split(host, r"\.")
    path = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:]*://[^/]*/([A-Za-z]{2})(?:[/?#]|$)", 1))
    return {"host": host, "domain": F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "."),
            "top": F.element_at(parts, -1), "suffix": F.when(path != "", path).otherwise(F.element_at(parts, -1))}


def _vote_logs(seen: DataFrame, column: str, tally: list[Column], prior: np.ndarray) -> DataFrame:
    """(column, column_logs): log P(lang | value) / P(lang), which is log P(value | lang) but for a constant, for each value."""
    n = seen.groupBy(column).agg(*tally)
    total = sum((F.col(f"c{k}") for k in range(len(prior))), F.lit(SMOOTH))
    logs = [F.log((F.col(f"c{k}") + SMOOTH * float(p)) / total / float(p)) for k, p in enumerate(prior)]
    return n.select(column, F.array(*logs).alias(f"{column}_logs"))


def identify(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
             text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per page: page_id, url, lang, probability, text_lang (by the text alone), declared, host.

    Runs jobs while the plan is built.
    """
    langs, logs = text_model(docs, text_col, lang_col)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    if not langs:
        empty = [F.lit(None).cast(t).alias(n) for n, t in (("lang", "string"), ("probability", "double"), ("text_lang", "string"), ("declared", "string"), ("host", "string"))]
        return rows.select("page_id", "url", *empty)
    held = docs.sparkSession.sparkContext.broadcast(logs)
    seen = rows.mapInArrow(_evidence(held, len(langs)), "page_id long, url string, said string, has_text boolean, text_logs array<double>")
    best = F.when(F.col("has_text"), (F.array_position(F.col("text_logs"), F.array_max("text_logs")) - 1).cast("int"))
    seen = stash(seen.withColumns(url_parts(F.col("url"))).withColumn("first", best), "evidence")
    # Hosts: counts by language at each level; a level's prior leans on the next one up.
    tally = [F.coalesce(F.sum((F.col("first") == k).cast("double")), F.lit(0.0)).alias(f"c{k}") for k in range(len(langs))]
    by_host = seen.where("host <> ''").groupBy("host", "domain", "top").agg(*tally)
    whole = np.array(seen.agg(*tally).first(), float) + 1.0
    shares = whole / whole.sum()
    prior = F.array(*[F.lit(float(x)) for x in shares])

    def level(name: str) -> DataFrame:
        return by_host.groupBy(name).agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(len(langs))]).select(
            name, F.array(*[F.col(f"c{k}") for k in range(len(langs))]).alias(f"{name}_n"))

    def lean(n: Column, up: Column) -> Column:
        total = F.aggregate(n, F.lit(0.0), lambda a, x: a + x) + SMOOTH
        return F.zip_with(n, up, lambda x, p: (x + SMOOTH * p) / total)
    hosts = by_host.select("host", "domain", "top", F.array(*[F.col(f"c{k}") for k in range(len(langs))]).alias("host_n"))
    hosts = hosts.join(level("domain"), "domain").join(level("top"), "top")
    hosts = hosts.select("host", lean(F.col("host_n"), lean(F.col("domain_n"), lean(F.col("top_n"), prior))).alias("host_prior"))
    joined = seen.join(hosts, "host", "left").withColumn("host_prior", F.coalesce("host_prior", prior))
    for column in ("said", "suffix"):
        joined = joined.join(_vote_logs(seen, column, tally, shares), column)
    parts = [F.col("text_logs")[k] + F.col("said_logs")[k] + F.col("suffix_logs")[k] + F.log(F.col("host_prior")[k]) for k in range(len(langs))]
    joined = joined.withColumn("all", F.array(*parts)).withColumn("top_log", F.array_max("all"))
    names = F.array(*[F.lit(x) for x in langs])
    return joined.select("page_id", "url", F.element_at(names, F.array_position("all", F.col("top_log")).cast("int")).alias("lang"),
                         (1 / F.aggregate("all", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top_log")))).alias("probability"),
                         F.when(F.col("first").isNotNull(), F.element_at(names, F.col("first") + 1)).alias("text_lang"), F.col("said").alias("declared"), "host")
