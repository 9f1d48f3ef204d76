"""What a crawl reads before it fetches, and what it leaves behind: robots.txt, sitemaps, and one file a page.

A robots.txt or a sitemap is one small row of text; rules and URLs are rows that join with the URLs of all sites.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from amberline.functions.text import url_slug
from amberline.operators.staging import staged
from amberline.session import ship

# robots.txt


def unquoted(c: Column) -> Column:
    """Percent escapes as UTF-8 characters; a % that begins no escape stays."""
    return F.url_decode(F.regexp_replace(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B"))


def plain(c: Column) -> Column:
    """A path with its query and fragment, without marks that nothing follows."""
    part = lambda k: F.regexp_extract(c, r"(?s)^([^?#]*)(\?[^#]*)?(#.*)?$", k)
    some = lambda k: F.when(F.length(part(k)) > 1, part(k)).otherwise("")
    return F.concat(F.regexp_replace(part(1), r"(?s)^((?:.*/)?[^;/]*);$", "$1"), some(2), some(3))


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """``site, n, prefix, allow``: the rules of each ``robots(site, status, body)`` that hold for ``agent``, numbered in file order.

    Lines are ``name: value``, without what follows a #, names in any case, values percent-decoded. Agent lines that
    follow each other open one group; an empty line ends it, and rules before the next agent line belong to none.
    The first group that names the agent (a part of the agent's name before any slash, in any case) holds,
    else the first group for *. An empty Disallow allows all. A status other than 200 is an error.
    """
    name = agent.split("/")[0].lower()
    body = F.when(F.col("status") == 200, F.coalesce("body", F.lit(""))).otherwise(F.raise_error(F.concat(F.lit("robots.txt of "), F.col("site"), F.lit(" returned HTTP "), F.coalesce(F.col("status").cast("string"), F.lit("nothing")))))
    lines = robots.select("site", F.posexplode(F.split(body, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")).alias("n", "line"))
    trim = lambda c: F.regexp_replace(c, "(?U)^[\\s\x1c-\x1f]+|[\\s\x1c-\x1f]+$", "")
    content = trim(F.split_part("line", F.lit("#"), F.lit(1)))
    field, value = F.lower(trim(F.split_part(content, F.lit(":"), F.lit(1)))), unquoted(trim(F.regexp_replace(content, "(?s)^[^:]*:", "")))
    kind = F.when(F.col("line") == "", "end").when(~F.contains(content, F.lit(":")), None).when(field == "user-agent", "agent").when(field.isin("allow", "disallow"), field).when(field.isin("crawl-delay", "request-rate"), "other")
    lines = lines.select("site", "n", kind.alias("kind"), value.alias("value")).where("kind is not null")
    each = W.partitionBy("site").orderBy("n")  # the lines of one file
    opens = (F.col("kind") == "agent") & ~F.lag("kind").over(each).eqNullSafe("agent")
    last = lambda what: F.coalesce(F.max(F.when(F.col("kind") == what, F.col("n"))).over(each), F.lit(-1))
    lines = lines.withColumns({"group": F.sum(opens.cast("long")).over(each), "live": last("agent") > last("end")})
    rules = F.col("live") & F.col("kind").isin("allow", "disallow", "other")
    named = (F.col("kind") == "agent") & F.contains(F.lit(name), F.lower("value"))
    groups = lines.groupBy("site", "group").agg(F.max(rules).alias("real"), F.max((F.col("kind") == "agent") & (F.col("value") == "*")).alias("any"), F.max(named).alias("named"))
    holds = groups.where("real").groupBy("site").agg(F.coalesce(F.min(F.when(F.col("named") & ~F.col("any"), F.col("group"))), F.min(F.when(F.col("any"), F.col("group")))).alias("group"))
    own = lines.where(F.col("live") & F.col("kind").isin("allow", "disallow")).join(holds, ["site", "group"])
    return own.select("site", "n", plain(F.col("value")).alias("prefix"), ((F.col("kind") == "allow") | (F.col("value") == "")).alias("allow"))


def path_of(url: Column) -> Column:
    """What robots rules are held against: the decoded URL without scheme and host, "/" if nothing is left."""
    path = plain(F.regexp_replace(unquoted(url), r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?", ""))
    return F.when(path == "", "/").otherwise(path)


def site_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def robots_allowed(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with ``allowed``: the first rule in file order whose prefix begins the path decides; no rule allows.

    Prefixes of a path are looked up by equality, and only as long ones as the site has rules, so the join
    stays an equi-join on (site, prefix).
    """
    each = urls.select(F.col(url)).distinct().withColumns({"_path": path_of(F.col(url)), "_site": site_of(F.col(url))})
    own = rules.groupBy("site", "prefix").agg(F.min(F.struct("n", "allow")).alias("rule"))
    lengths = own.groupBy("site").agg(F.collect_set(F.length("prefix")).alias("lengths"))  # of one file
    each = each.join(lengths, F.col("_site") == F.col("site")).select(url, "_path", "_site", F.explode("lengths").alias("_n")).where(F.col("_n") <= F.length("_path"))
    hit = each.withColumn("_prefix", F.substring("_path", F.lit(1), F.col("_n"))).join(own, (F.col("_site") == F.col("site")) & (F.col("_prefix") == F.col("prefix")))
    best = hit.groupBy(url).agg(F.min("rule").alias("_rule")).select(F.col(url).alias("_url"), F.col("_rule.allow").alias("allowed"))
    return urls.join(best, F.col(url).eqNullSafe(F.col("_url")), "left").drop("_url").withColumn("allowed", F.coalesce("allowed", F.lit(True)))


# sitemaps

SITEMAP = "url array<struct<loc:string>>, sitemap array<struct<loc:string>>"


def sitemap_entries(files: DataFrame) -> DataFrame:
    """``location, place, listed, loc``: URLs, and other sitemaps (``listed``), that each ``files(location, body)`` of XML names, in order."""
    read = F.from_xml("body", SITEMAP, {"ignoreNamespace": "true", "mode": "FAILFAST"})
    rows = files.select("location", read.alias("x")).select("location", F.inline(F.array(F.struct(F.lit(False).alias("listed"), F.col("x.url").alias("e")), F.struct(F.lit(True).alias("listed"), F.col("x.sitemap").alias("e")))))
    out = rows.select("location", "listed", F.posexplode("e").alias("place", "e")).select("location", "listed", F.col("place").cast("long").alias("place"), F.regexp_replace("e.loc", r"(?U)^\s+|\s+$", "").alias("loc"))
    return out.where("loc <> ''")


def sitemap_urls(files: DataFrame, root: str, most: int = 8) -> DataFrame:
    """``url, place``: what the sitemap at ``root`` names, itself and through sitemaps that it lists, ``most`` levels deep.

    ``place`` is an array that sorts as a reader going from file to file would meet the URLs. A file is read once,
    where it is met first, so files that list each other end; a listed file that is not there adds nothing.
    """
    entries = staged(sitemap_entries(files), "sitemap")
    level = entries.where(F.col("location") == root).select("listed", F.array("place").alias("place"), "loc")
    seen = entries.sparkSession.createDataFrame([(root,)], "location string")
    found = level.where("not listed")
    for _ in range(most):
        ahead = level.where("listed").groupBy(F.col("loc").alias("location")).agg(F.min("place").alias("before"))
        ahead = staged(ahead.join(seen, "location", "left_anti"), "sitemap")
        if ahead.isEmpty():
            break
        level = staged(entries.join(ahead, "location").select("listed", F.concat("before", F.array("place")).alias("place"), "loc"), "sitemap")
        seen = seen.unionByName(ahead.select("location"))
        found = found.unionByName(level.where("not listed"))
    return found.select(F.col("loc").alias("url"), "place")


# one file a page


class SlugFiles(DataSource):
    """Writes rows (slug, body) as ``slug.json`` files into a folder that appears when all of them are there."""

    @classmethod
    def name(cls) -> str:
        return "slug_files"

    def schema(self) -> str:
        return "slug string, body string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return SlugWriter(self.options["path"], overwrite, uuid.uuid4().hex[:12])


@dataclass
class Written(WriterCommitMessage):
    files: int


def opened(path: str) -> tuple[Any, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if not path.startswith("file:") else path.replace("file:", "file://", 1))


class SlugWriter(DataSourceWriter):
    """Tasks write beside the folder; a second attempt at a task writes the same files again, each renamed into place when whole."""

    def __init__(self, path: str, overwrite: bool, run: str):
        self.path, self.overwrite, self.run = path.rstrip("/"), overwrite, run

    @property
    def beside(self) -> str:
        return f"{self.path}.{self.run}"

    def write(self, rows: Iterator[Any]) -> Written:
        store, folder = opened(self.beside)
        store.create_dir(folder, recursive=True)
        n = 0
        for row in rows:
            part = f"{folder}/.{row['slug']}.{uuid.uuid4().hex[:8]}"
            with store.open_output_stream(part) as out:
                out.write(row["body"].encode())
            store.move(part, f"{folder}/{row['slug']}.json")
            n += 1
        return Written(n)

    def commit(self, messages: list[Any]) -> None:
        from pyarrow import fs

        store, folder = opened(self.beside)
        _, to = opened(self.path)
        store.create_dir(folder, recursive=True)
        there = store.get_file_info(to).type != fs.FileType.NotFound
        if there and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(to)
        if there:
            store.delete_dir(to)
        store.move(folder, to)

    def abort(self, messages: list[Any]) -> None:
        from pyarrow import fs

        store, folder = opened(self.beside)
        if store.get_file_info(folder).type != fs.FileType.NotFound:
            store.delete_dir(folder)


def write_corpus(pages: DataFrame, path: str, url: str = "url", overwrite: bool = True) -> None:
    """One JSON file a page, named by the slug of its URL; all columns go in, in order.

    A slug that begins with _ or . gets a - before it, since readers pass over such files. URLs whose slugs clash
    are an error, before anything is written.
    """
    spark: SparkSession = ship(pages.sparkSession)
    own = url_slug(F.col(url))
    slug = F.when(own.rlike("^[_.]"), F.concat(F.lit("-"), own)).otherwise(own)
    named = pages.select(slug.alias("slug"), F.to_json(F.struct(*pages.columns), {"ignoreNullFields": "false"}).alias("body"))
    clash = named.groupBy("slug").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or slug is null").limit(5).collect()
    if clash:
        raise ValueError(f"pages share a file name or have none: {json.dumps([r['slug'] for r in clash])}")
    spark.dataSource.register(SlugFiles)
    named.write.format("slug_files").mode("overwrite" if overwrite else "append").save(path)
