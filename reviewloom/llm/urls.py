"""URL rules in a sorted digest array.

A rule is a host and the start of a path; its key is the 64-bit XXH64 of host
followed by path.  The index file holds the sorted keys, then the rules' full
strings and verdicts, and beside them the sorted keys of the rules' hosts, each
with the lengths of the paths that it has rules for.  Each worker memory-maps
it.  A url asks which of its host's endings are hosts of rules, no longer ones
than the rules have, and then for each of these and each of its lengths whether
that start of the path is a rule.  The questions of many urls are hashed and
looked up in one vectorised binary search, every hit is confirmed against the
stored string, and the longest confirmed rule wins; of two alike that with the
longer host.  A url that no rule fits gets the method's own verdict: a
blocklist allows what it doesn't hold.

An index within ``max_index_bytes`` is shipped to the executors as a file.  A
larger rule set is never collected: the same questions are joined to the rules
by digest and string instead, with the same answers.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewloom.staging import table

MAX_INDEX_BYTES = 64 << 20
_ROWS, _QUESTION_CHARS = 4096, 8 << 20  # urls and characters asked at once
ELSE = "allow"
VERDICTS = ("allow", "block")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the registered query: host, path, verdict.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def _lower(host: str) -> str:
    return host.translate(str.maketrans(_UPPER, _LOWER))


def _verdict(given: str | None) -> str:
    known = _lower(given or "null").strip(" ")
    if known not in VERDICTS:
        raise ValueError(f"a rule's verdict is one of {VERDICTS}, not {known!r}")
    return known


def build_index(rules: list[tuple[str, str, str]]) -> bytes:
    """The index file: counts, sorted keys, string offsets, the hosts' keys and their paths' lengths, verdicts, strings.

    Rules without a host, or with a path that no url's path can start with, fit
    nothing and are left out; of a rule with two verdicts "block" counts.
    """
    held: dict[tuple[str, str], bool] = {}
    for host, path, verdict in rules:
        if host and (not path or path.startswith("/")):
            rule = (_lower(host), path or "")
            held[rule] = held.get(rule, False) or verdict == "block"
    keyed = sorted((xxhash.xxh64_intdigest(rule := (host + path).encode()), rule, block) for (host, path), block in held.items())
    lengths: dict[str, set[int]] = {}
    for host, path in held:
        lengths.setdefault(host, set()).add(len(path))
    hosts = sorted((xxhash.xxh64_intdigest(host.encode()), sorted(own)) for host, own in lengths.items())
    numbers = lambda x: np.array(x, "<u8").tobytes()
    labels, chars = max((h.count(".") + 1 for h in lengths), default=0), max(map(len, lengths), default=0)
    head = numbers([len(keyed), len(hosts), sum(len(own) for _, own in hosts), labels, chars])
    spans = lambda sizes: numbers(np.cumsum([0, *sizes], dtype=np.uint64))
    body = [numbers([k[0] for k in keyed]), spans(len(k[1]) for k in keyed), numbers([h[0] for h in hosts]), spans(len(h[1]) for h in hosts), numbers([n for _, own in hosts for n in own])]
    return head + b"".join(body) + bytes(k[2] for k in keyed) + b"".join(k[1] for k in keyed)


class Index:
    """A memory-mapped index file."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        n, h, m, self.labels, self.chars = (int(x) for x in data[:40].view("<u8"))
        at = 40

        def take(count: int) -> np.ndarray:
            nonlocal at
            at += 8 * count
            return data[at - 8 * count : at].view("<u8")

        self.keys, self.offsets, self.hosts, self.spans, self.lengths = take(n), take(n + 1), take(h), take(h + 1), take(m)
        self.block, self.strings = data[at : at + n], data[at + n :]

    def probe(self, asked: list[bytes]) -> np.ndarray:
        """The place of each asked string among the rules, or -1."""
        keys = np.array([xxhash.xxh64_intdigest(a) for a in asked], np.uint64)
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        found = np.full(len(asked), -1)
        for i in np.nonzero(low < high)[0]:
            for k in range(low[i], high[i]):  # equal keys: one of them has the same string, or none
                if self.strings[int(self.offsets[k]) : int(self.offsets[k + 1])].tobytes() == asked[i]:
                    found[i] = k
        return found

    def known_endings(self, hosts: list[str]) -> list[list[tuple[str, list[int]]]]:
        """Per host its endings that have rules, each with its paths' lengths; a digest met by chance costs a question and no more."""
        endings = [host_endings(h, self.labels, self.chars) for h in hosts]
        flat = np.array([xxhash.xxh64_intdigest(e.encode()) for own in endings for e in own], np.uint64)
        low, high = (np.searchsorted(self.hosts, flat, side).tolist() for side in ("left", "right"))
        at, out = 0, []
        for own in endings:
            known = [(e, sorted({n for j in range(low[k], high[k]) for n in self.lengths[int(self.spans[j]) : int(self.spans[j + 1])].tolist()})) for k, e in enumerate(own, at) if low[k] < high[k]]
            out.append(known)
            at += len(own)
        return out

    def judge(self, hosts: list[str], paths: list[str]) -> Iterator[tuple[str | None, str]]:
        """(rule or None, verdict) of each url, in order."""
        asked, ends, size = [], [0], 0

        def answers() -> Iterator[tuple[str | None, str]]:
            found = self.probe(asked)
            for a, b in zip(ends, ends[1:]):
                hit = next((i for i in range(a, b) if found[i] >= 0), None)  # the longest comes first
                yield (None, ELSE) if hit is None else (asked[hit].decode(), "block" if self.block[found[hit]] else "allow")

        for known, path in zip(self.known_endings(hosts), paths):
            own = [(len(e) + n, len(e), e, n) for e, lengths in known for n in lengths if n <= len(path)]
            asked += [(e + path[:n]).encode() for _, _, e, n in sorted(own, reverse=True)]
            ends.append(len(asked))
            size += sum(total for total, *_ in own)
            if size > _QUESTION_CHARS:
                yield from answers()
                asked, ends, size = [], [0], 0
        yield from answers()


def host_endings(host: str, most_labels: int, most_chars: int) -> list[str]:
    """The host and its parent domains, shortest first, as far as rules can have them."""
    labels, out, ending = host.rsplit(".", most_labels), [], None
    for label in reversed(labels[-most_labels:] if most_labels and host else []):
        ending = label if ending is None else f"{label}.{ending}"
        if len(ending) > most_chars:
            break
        out.append(ending)
    return out


def parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host in lower case and path of a url; both empty if it is null or has no ``://``."""
    known = F.coalesce(url, F.lit(""))
    after = F.regexp_extract(known, r"(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, id_col: str = "page_id", url_col: str = "url", max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule (null if none fits), verdict.

    ``rules`` is a list, or a frame (host, path, verdict).  Nulls: a null url
    has an empty host and path, fits no rule and gets the method's verdict; a
    null id stays; a rule without a host fits nothing, one without a path fits
    all of its host.  Verdicts are read without regard to case and blanks
    around them; a rule with a host and any other verdict, or null, raises
    ValueError before a url is judged.  Ties: see above; a rule given with both
    verdicts blocks.
    A host of any length asks no more endings than the rules' hosts have
    labels, and a path of any length no more starts than they have lengths.
    Empty tables and empty rule sets work; repeated rows stay; other columns
    are not read.
    """
    host, path = parts(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    if isinstance(rules, DataFrame):
        rules = rules.select("host", F.coalesce("path", F.lit("")).alias("path"), F.trim(F.translate("verdict", _UPPER, _LOWER)).alias("verdict")).where("host <> ''")
        odd = F.min(F.when(~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False)), F.coalesce("verdict", F.lit("null"))))
        found = rules.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 40), F.lit(0)).alias("n"), odd.alias("odd")).first()
        if found.odd is not None:
            raise ValueError(f"a rule's verdict is one of {VERDICTS}, not {found.odd!r}")
        if found.n > max_index_bytes:
            return _judge_by_join(rows, rules, id_col)
        rules = [(r.host, r.path, r.verdict) for r in rules.toLocalIterator()]  # within max_index_bytes
    rules = [(host, path, _verdict(verdict)) for host, path, verdict in rules if host]
    return _judge_by_index(rows, build_index(rules), id_col)


def _judge_by_index(rows: DataFrame, index: bytes, id_col: str) -> DataFrame:
    spark = rows.sparkSession
    name = f"url-rules-{hashlib.sha256(index).hexdigest()[:32]}.idx"
    if not any(known.endswith(f"/{name}") for known in spark.sparkContext.listFiles):
        own = os.path.join(tempfile.mkdtemp(), name)
        with open(own, "wb") as f:
            f.write(index)
        spark.sparkContext.addFile(own)  # the driver serves it to every executor, new ones too

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Index(SparkFiles.get(name))
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(start, _ROWS)
                rule, verdict = zip(*held.judge(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["id", "host", "path", "rule", "verdict"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)


def _judge_by_join(rows: DataFrame, rules: DataFrame, id_col: str) -> DataFrame:
    """The same for rule sets of any size: hosts' endings meet the rules' hosts, then starts of paths the rules; distinct (host, path) are asked once."""
    known = rules.where("path = '' OR path LIKE '/%'").select(F.translate("host", _UPPER, _LOWER).alias("ending"), "path", "verdict")
    known = known.groupBy("ending", "path").agg(F.max("verdict").alias("verdict"))  # "block" is the greater
    most = known.agg(F.max(F.size(F.split("ending", r"\."))).alias("labels")).first()["labels"] or 0  # one row
    lengths = known.select("ending", F.length("path").alias("n")).distinct()
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(most, 1)))), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    asked = rows.select("host", "path").where("host <> ''").distinct().select("host", "path", F.explode(parents).alias("ending"))
    asked = asked.join(lengths, "ending").where(F.col("n") <= F.length("path")).select("host", "path", "ending", F.expr("left(path, n)").alias("start"))
    keyed = lambda df, start: df.withColumn("key", F.xxhash64(F.concat("ending", start)))
    found = keyed(asked, "start").join(keyed(known.withColumnRenamed("path", "start"), "start"), ["key", "ending", "start"])
    best = found.groupBy("host", "path").agg(F.max(F.struct((F.length("ending") + F.length("start")).alias("n"), F.length("ending").alias("of_host"), F.concat("ending", "start").alias("rule"), "verdict")).alias("best"))
    joined = rows.join(best, ["host", "path"], "left")
    return joined.select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(ELSE)).alias("verdict"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES)


OP3_SQL = r"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES
    ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
    ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
cut AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (SELECT url, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, max_by(verdict, length(rule_host || rule_path)) AS verdict
    FROM (SELECT DISTINCT url, host, path FROM split) JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY url)
SELECT page_id, host, path, fits.rule AS rule, coalesce(fits.verdict, 'allow') AS verdict FROM split LEFT JOIN fits USING (url)
"""
