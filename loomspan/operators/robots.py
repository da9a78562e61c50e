"""Robots rules as a small dimension, joined to URLs by host; the longest matching rule decides."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U

MAX_CRAWL_DELAY = 10.0


def rules(body: str | None, agent: str) -> dict:
    """Rules and delay of the group for an agent, else of the group for all."""
    groups: list[tuple[list[str], list[tuple[bool, str]], list[float]]] = []
    naming = False
    for line in (body or "").splitlines():
        key, sep, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not sep:
            continue
        if key == "user-agent":
            if not naming:
                groups.append(([], [], []))
            groups[-1][0].append(value.lower())
            naming = True
            continue
        naming = False
        if groups and key in ("allow", "disallow") and value:
            groups[-1][1].append((key == "allow", value))
        elif groups and key == "crawl-delay":
            try:
                groups[-1][2].append(float(value))
            except ValueError:
                pass
    name = agent.split("/")[0].strip().lower()
    own = [g for g in groups if any(a != "*" and a and a in name for a in g[0])]
    own = own or [g for g in groups if "*" in g[0]]
    out = [{"allow": a, "pattern": p, "rx": _regex(p)} for g in own for a, p in g[1]]
    delays = [d for g in own for d in g[2]]
    return {"rules": out, "delay": min(delays[0], MAX_CRAWL_DELAY) if delays else None}


def _regex(pattern: str) -> str:
    end = pattern.endswith("$")
    body = ".*".join(re.sub(r"([^A-Za-z0-9_/%~-])", r"\\\1", p) for p in pattern.rstrip("$" if end else "").split("*"))
    return "^" + body + (r"\z" if end else "")


def parsed_rules(body: Column, agent: str) -> Column:
    @F.pandas_udf("string")
    def run(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: json.dumps(rules(b, agent)))

    return F.from_json(run(F.coalesce(body, F.lit(""))), "rules array<struct<allow:boolean,pattern:string,rx:string>>, delay double")


def site_of(url: Column) -> Column:
    return F.concat(U.scheme(url), F.lit("://"), U.netloc(url))


def allowed(urls: DataFrame, robots: DataFrame, agent: str, url: str = "url", max_broadcast: int = 50_000) -> DataFrame:
    """``urls`` with ``allowed`` and ``crawl_delay``; robots has (site, body), and no row allows all.

    Robots files are broadcast when there are at most ``max_broadcast`` (counted first).
    """
    dim = robots.select("site", parsed_rules(F.col("body"), agent).alias("_r")).groupBy("site").agg(F.first("_r").alias("_r"))
    if robots.limit(max_broadcast + 1).count() <= max_broadcast:
        dim = F.broadcast(dim)
    rows = urls.withColumn("site", site_of(F.col(url))).join(dim, "site", "left")
    q = U.query(F.col(url))
    way = F.concat(F.when(U.path(F.col(url)) == "", "/").otherwise(U.path(F.col(url))), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    rows = rows.withColumn("_way", way)
    hit = F.filter(F.coalesce(F.col("_r.rules"), F.array().cast("array<struct<allow:boolean,pattern:string,rx:string>>")), lambda r: F.call_function("rlike", F.col("_way"), r["rx"]))
    best = F.array_max(F.transform(hit, lambda r: F.struct(F.length(r["pattern"]).alias("n"), r["allow"].alias("allow"))))
    return rows.withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).withColumn("crawl_delay", F.col("_r.delay")).drop("_r", "_way", "site")


def effective_delay(crawl_delay: Column, configured: float = 1.0) -> Column:
    return F.greatest(F.lit(configured), F.when(crawl_delay.isNull(), F.lit(0.0)).otherwise(F.least(crawl_delay, F.lit(MAX_CRAWL_DELAY))))
