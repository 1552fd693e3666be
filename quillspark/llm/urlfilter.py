"""URL filters: blocked Bloom filter, then an exact hash join.

An entry is a host (A-Z lower-cased) and the start of a path.  It fits a URL if the URL's host is the entry's or one
of its subdomains, and the URL's path starts with the entry's.  Rules are held against host and path as they stand in
the URL.  Entries that are only listed are canonical URLs, and are held against the canonical form: without user,
default port and final dot of the host, and with ``/`` for an empty path.

A URL is expanded into the keys (host suffix, path prefix) that an entry could have: suffixes of no more labels than
any entry has, prefixes of the lengths that entries have.  The Bloom filter is one packed array of 64-bit blocks, at
most ``FILTER_BLOCKS`` of them, sent to the rows, so that testing a key moves no row.  URLs with keys that pass go to
an exact join with the entries, which removes false positives; the longest entry wins, and rules win over listed ones.
Verdicts, of URLs that an entry fits only, go back to the pages: sent while they are few, joined beyond that.

Defined cases: a null URL or one without ``://`` has empty host and path and fits no entry; nulls in the list are
passed over; of equal entries with different verdicts, block wins; repeated URLs are judged once and all get the
verdict; an empty list fits nothing; URLs may be of any length; columns of ``pages`` pass through whatever their names,
but for one that is called like the result, which takes its place; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import ascii_lower, materialize, numbered

BITS_PER_ENTRY = 16
WORD_BITS = 64
PROBES = 4
FILTER_BLOCKS = 2_000_000  # 16 MB; a longer list lets more false positives through to the exact join
BROADCAST_ROWS = 200_000  # of entries, or of verdicts


def host_of(url: Column) -> Column:
    rest = _after_scheme(url)
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    return F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))


def canonical_host(host: Column) -> Column:
    named = F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":(80|443)?$", "")
    return F.regexp_replace(named, r"\.$", "")


def canonical_path(path: Column) -> Column:
    return F.when(path == "", F.lit("/")).otherwise(path)


def _key_hash(is_rule: Column, host: Column, path: Column) -> Column:
    return F.xxhash64(is_rule, host, path)


def _block(key_hash: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(key_hash, 8), F.lit(blocks)).cast("int")


def _mask(key_hash: Column) -> Column:
    """The bits of a key within its 64-bit block."""
    second = F.xxhash64(key_hash)
    bits = []
    for i in range(PROBES):
        at = F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        bits.append(F.call_function("shiftleft", F.lit(1).cast("long"), at))
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def bloom_filter(keys: DataFrame, n_entries: int) -> tuple[DataFrame, int]:
    """Blocked Bloom filter of the ``key_hash`` column: one row with an array ``bits``, a 64-bit word to a block."""
    blocks = min(max(1, -(-n_entries * BITS_PER_ENTRY // WORD_BITS)), FILTER_BLOCKS)
    words = keys.select(_block(F.col("key_hash"), blocks).alias("block"), _mask(F.col("key_hash")).alias("mask"))
    words = words.groupBy("block").agg(F.bit_or("mask").alias("word"))
    every = keys.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block"))
    words = every.join(words, "block", "left").select("block", F.coalesce("word", F.lit(0).cast("long")).alias("word"))
    ordered = F.array_sort(F.collect_list(F.struct("block", "word")))  # FILTER_BLOCKS at most
    return words.agg(ordered.alias("w")).select(F.col("w.word").alias("bits")), blocks


def may_hold(bits: Column, key_hash: Column, blocks: int) -> Column:
    """Whether a filter's bits allow for a key; always true for keys that are in it."""
    return F.get(bits, _block(key_hash, blocks)).bitwiseAND(_mask(key_hash)) == _mask(key_hash)


def _possible(host: Column, path: Column, is_rule: bool, labels: int, lengths: list[int]) -> Column:
    """The keys that entries of one kind could have to fit."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max(labels, 1)))), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    fitting = F.filter(F.array(*[F.lit(x) for x in lengths]).cast("array<int>"), lambda n: n <= F.length(path))
    prefixes = F.transform(fitting, lambda n: F.left(path, n))
    rule = F.lit(is_rule)
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(rule.alias("r"), s.alias("h"), p.alias("p"), _key_hash(rule, s, p).alias("k")))))


def judge(urls: DataFrame, entries: DataFrame, *, url_col: str = "url") -> DataFrame:
    """(url, best) per distinct URL that an entry fits: the winning entry's is_rule, key and verdict, among others.

    ``entries`` has host, path, verdict and ``is_rule``: rules go before entries that are only listed.
    """
    listed = entries.where("host is not null and path is not null and verdict is not null and is_rule is not null")
    listed = listed.select(ascii_lower(F.col("host")).alias("host"), "path", "is_rule", "verdict").groupBy("host", "path", "is_rule").agg(F.max("verdict").alias("verdict"))
    listed = materialize(listed.withColumn("key_hash", _key_hash(F.col("is_rule"), F.col("host"), F.col("path"))), "listed")
    kinds = listed.groupBy("is_rule").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.size(F.split("host", r"\."))).alias("labels"),
        F.sort_array(F.collect_set(F.length("path"))).alias("lengths"),
    )
    found = {r.is_rule: r for r in kinds.collect()}  # two rows: the lengths that paths of entries have are few
    total = sum(r.n for r in found.values())
    bits, blocks = bloom_filter(listed, total)
    read = urls.select(F.col(url_col).alias("url")).where(F.instr("url", "://") > 0)
    read = read.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host <> ''")
    keys = [_possible(F.col("host"), F.col("path"), True, found[True].labels, found[True].lengths)] if True in found else []
    if False in found:
        keys.append(_possible(canonical_host(F.col("host")), canonical_path(F.col("path")), False, found[False].labels, found[False].lengths))
    every = F.concat(*keys) if keys else F.array().cast("array<struct<r: boolean, h: string, p: string, k: bigint>>")
    # one row of at most FILTER_BLOCKS words
    probed = read.crossJoin(F.broadcast(materialize(bits, "filter")))
    passes = lambda x: may_hold(F.col("bits"), x["k"], blocks)
    passed = probed.select("url", F.explode(F.filter(every, passes)).alias("x")).distinct()
    sent = F.broadcast(listed) if total <= BROADCAST_ROWS else listed
    exact = (F.col("x.r") == F.col("is_rule")) & (F.col("x.h") == F.col("host")) & (F.col("x.p") == F.col("path"))
    hits = passed.join(sent, exact)
    key = F.concat("host", "path")
    return hits.groupBy("url").agg(F.max(F.struct("is_rule", F.length(key).alias("n"), F.length("host").alias("m"), key.alias("key"), "verdict")).alias("best"))


def filter_urls(pages: DataFrame, entries: DataFrame, *, url_col: str = "url", default: str = "allow", info_col: str = "url_verdict") -> DataFrame:
    """``pages`` with a struct column ``url_verdict`` (host, path, rule, verdict); only rules are named in ``rule``."""
    best = materialize(judge(pages, entries, url_col=url_col).select(F.col("url").alias("hit_url"), "best"), "verdicts")
    if best.count() <= BROADCAST_ROWS:
        best = F.broadcast(best)
    held, names, kept = numbered(pages, info_col)
    url = F.col(names[pages.columns.index(url_col)])
    joined = held.join(best, url == F.col("hit_url"), "left")
    result = F.struct(
        host_of(url).alias("host"),
        path_of(url).alias("path"),
        F.when(F.col("best.is_rule"), F.col("best.key")).alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
    return joined.select(*[F.col(n).alias(c) for n, c in kept], result.alias(info_col))
