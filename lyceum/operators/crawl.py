"""Seeds and frontiers of a crawl over stored pages: what to visit, not how to fetch it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lyceum.functions import fixed
from lyceum.functions import url as U
from lyceum.session import shared_folder


def by_name(targets: DataFrame, needle: str) -> DataFrame:
    """Targets whose name contains the needle, whatever its case."""
    return targets.where(F.contains(F.lower("name"), F.lit(needle.lower())))


def by_name_or_alias(targets: DataFrame, needle: str) -> DataFrame:
    low = F.lit(needle.lower())
    alias = F.exists("alias", lambda a: F.contains(F.lower(a), low))
    return targets.where(F.contains(F.lower("name"), low) | F.coalesce(alias, F.lit(False)))


def seeds(targets: DataFrame) -> DataFrame:
    """(name, place, page_type, url): the base URL, then the admission paths, then the placement paths."""

    def typed(paths: Column, kind: str) -> Column:
        return F.transform(paths, lambda p: F.struct(F.lit(kind).alias("page_type"), p.alias("path")))

    base = F.array(F.struct(F.lit("general").alias("page_type"), F.lit("").alias("path")))
    every = F.concat(base, typed(F.col("admission_paths"), "admission"), typed(F.col("placement_paths"), "placement"))
    each = targets.select("name", "base_url", F.posexplode(every).alias("place", "seed"))
    url = F.when(F.col("seed.path") == "", F.col("base_url")).otherwise(U.joined(F.col("base_url"), F.col("seed.path")))
    return each.select("name", "place", F.col("seed.page_type").alias("page_type"), url.alias("url"))


def page_links(links: DataFrame, within: Column, current: Column, url: str = "url") -> DataFrame:
    """Links worth a visit, with the type their path suggests."""
    return links.where(U.is_page_link(F.col(url), within)).withColumn("page_type", U.link_type(F.col(url), current))


def frontier(start: DataFrame, edges: DataFrame, rounds: int = 3, budget: int = fixed.PAGE_BUDGET) -> DataFrame:
    """(site, url, depth): what is visited from start (site, url) along edges (url, to), at most `budget` pages a site.

    A round follows the links of the last one, leaves out what was visited, and takes the smallest URLs of each site up to what is left
    of its budget; sites without any left are joined no more. So no round holds more than `budget` rows of a site, however many links
    its pages have. Each round is checkpointed, so the plan does not grow.
    """
    context = start.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(start.sparkSession))
    rank = F.row_number().over(Window.partitionBy("site").orderBy("url"))

    def within(pages: DataFrame, left: Column, depth: int) -> DataFrame:
        """The first pages of each site; the limit that is the same for all sites cuts before the shuffle."""
        first = pages.withColumn("_rank", rank).where(F.col("_rank") <= budget).where(F.col("_rank") <= left)
        return first.select("site", "url", F.lit(depth).alias("depth")).checkpoint()

    visited = front = within(start.select("site", "url").distinct(), F.lit(budget), 0)
    for depth in range(1, rounds + 1):
        left = visited.groupBy("site").agg((F.lit(budget) - F.count("*")).alias("_left")).where(F.col("_left") > 0)
        found = front.join(left, "site").join(edges, "url").select("site", F.col("to").alias("url"), "_left").distinct()
        front = within(found.join(visited, ["site", "url"], "left_anti"), F.col("_left"), depth)
        if front.isEmpty():
            break
        visited = visited.unionByName(front)
    return visited
