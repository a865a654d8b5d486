"""URL filter on a sorted digest array.

The block list's entries are hosts, domains and canonical URLs.  Their 64-bit xxhash keys
lie sorted in files that every task memory-maps; a page's candidates (its canonical URL, its
host and each parent domain) are probed by vectorised binary search, and every hit is
confirmed against the stored string, so colliding digests block nothing.

Canonical: no scheme, user, default port, fragment, tracking parameters (utm_*, ref, fbclid,
gclid) or trailing slash; host in lower case without a leading "www.".

Scale: pages aren't shuffled, whatever the list's size; the list is range-split into files of about a
million keys, and a task maps only those that it probes.

Defined results: a null URL, or one without a host, is never blocked; null and empty entries are
ignored, repeated ones count once; a repeated page is judged in each row; of several hits the most specific
is named (URL, host, then the longest domain).  Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import DigestArray, need

#: Of a host's pages, this share of spam puts the host on the list.
SPAM_SHARE = 0.2
SPAM_MARK = "%%%"


def host(url: str | Column) -> Column:
    """The host in lower case without www., '' if there is none."""
    url = F.col(url) if isinstance(url, str) else url
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), r"^www\.", "")


def canonical(url: str | Column) -> Column:
    """Host, other than default port, path and query."""
    url = F.col(url) if isinstance(url, str) else url
    rest = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/:?#]*(?::[^/@?#]*@[^/:?#]*)?([^#]*)", 1)
    rest = F.regexp_replace(rest, r"^:(80|443)($|[/?])", "$2")
    rest = F.regexp_replace(rest, r"([?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&]*", "$1")
    rest = F.regexp_replace(rest, r"&&+", "&")
    rest = F.regexp_replace(rest, r"\?&", "?")
    rest = F.regexp_replace(rest, r"[?&]+$", "")
    return F.concat(host(url), F.regexp_replace(rest, r"/+$", ""))


def candidates(url: str | Column) -> Column:
    """The strings that may be on the list, the most specific first."""
    h, c = host(url), canonical(url)
    labels = F.split(h, r"\.")
    # domains of two labels at least; the first is the host itself
    tails = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(h == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.array(c), tails)))


def build(entries: DataFrame, *, entry_col: str = "entry") -> DigestArray:
    rows = need(entries, entry_col).toDF("entry").where("entry is not null and entry <> ''").distinct()
    return DigestArray.store(rows.withColumn("key", F.xxhash64("entry")), "key", "entry", "urls")


def blocked(pages: DataFrame, block_list: DigestArray, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, url, entry) of each blocked page, entry being the most specific hit."""
    rows = need(pages, id_col, url_col).toDF("id", "url").where("url is not null").withColumn("c", candidates("url"))
    rows = rows.withColumn("k", F.transform("c", lambda c: F.xxhash64(c)))
    kind = rows.schema["id"].dataType.simpleString()

    def probe(batches):
        for batch in batches:
            sizes = pc.list_value_length(batch["c"]).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(batch)), sizes)
            which, where = block_list.find(batch["k"].flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            if not len(which):
                continue
            order = np.argsort(which, kind="stable")
            which, where = which[order], where[order]
            strings = block_list.values(where)
            same = pc.equal(batch["c"].flatten().take(pa.array(which)).cast(pa.large_string()), strings).to_numpy(zero_copy_only=False)
            page, at = np.unique(row[which[same]], return_index=True)
            page = pa.array(page)
            yield pa.RecordBatch.from_arrays([batch["id"].take(page), batch["url"].take(page), strings.filter(pa.array(same)).take(pa.array(at)).cast(pa.string())], ["id", "url", "entry"])

    return rows.mapInArrow(probe, f"id {kind}, url string, entry string").toDF(id_col, "url", "entry")


def spam_entries(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", share: float = SPAM_SHARE, mark: str = SPAM_MARK) -> DataFrame:
    """The list that the pages themselves give: canonical URLs of pages with the mark, and hosts with the share of such pages."""
    rows = need(pages, url_col, html_col).toDF("url", "html").select(host("url").alias("host"), canonical("url").alias("entry"), F.coalesce(F.contains("html", F.lit(mark)), F.lit(False)).alias("spam"))
    rows = rows.where("host <> ''")
    hosts = rows.groupBy("host").agg(F.avg(F.col("spam").cast("int")).alias("s")).where(F.col("s") >= share).select(F.col("host").alias("entry"))
    return rows.where("spam").select("entry").union(hosts).distinct()
