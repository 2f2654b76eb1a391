"""Crawling rules of robots files."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULE = "struct<agents:array<string>,allow:boolean,pattern:string,delay:double>"


def groups(content: str | None) -> list[dict]:
    """The groups of a file: (agents, rules, delay). Agent lines in a row share a group; an agent line after
    a rule, or a blank line, begins a new one."""
    out: list[dict] = []
    fresh = True
    for raw in (content or "").splitlines():
        line = raw.split("#", 1)[0].strip()
        key, mark, value = (x.strip() for x in line.partition(":"))
        key = key.lower()
        if not line:
            fresh = True
        elif mark and key == "user-agent":
            if fresh or out[-1]["rules"]:
                out.append({"agents": [], "rules": [], "delay": None})
            out[-1]["agents"].append(value)
            fresh = False
        elif mark and out and not fresh and key in ("allow", "disallow"):
            out[-1]["rules"].append((key == "allow", value))
        elif mark and out and not fresh and key == "crawl-delay" and re.fullmatch(r"\d+(\.\d+)?", value):
            out[-1]["delay"] = float(value)
    return out


def sitemaps_of(content: str | None) -> list[str]:
    found = (re.match(r"(?i)\s*sitemap\s*:\s*(\S+)", line) for line in (content or "").splitlines())
    return [m[1] for m in found if m]


def pattern(rule: str) -> str:
    """A rule as a regular expression: * for any run, $ at the end for the end."""
    body = "".join(".*" if c == "*" else re.escape(c) for c in rule.removesuffix("$"))
    return "^" + body + ("$" if rule.endswith("$") else "")


def rules(files: DataFrame) -> DataFrame:
    """(host, agent, allow, pattern, size, delay) of robots files (host, content). A file of null content,
    which could not be fetched, forbids everything."""

    @F.pandas_udf(f"array<{RULE}>")
    def read(contents: pd.Series) -> pd.Series:
        def one(content: str | None) -> list[dict]:
            if content is None:
                return [{"agents": ["*"], "allow": False, "pattern": "/", "delay": None}]
            return [
                {"agents": g["agents"], "allow": a, "pattern": p, "delay": g["delay"]} for g in groups(content) for a, p in (g["rules"] or [(True, "")])
            ]

        return contents.map(one)

    @F.pandas_udf("string")
    def compiled(found: pd.Series) -> pd.Series:
        return found.map(pattern)

    rows = files.select("host", F.explode(read("content")).alias("r")).select("host", F.explode("r.agents").alias("agent"), "r.allow", "r.pattern", "r.delay")
    return rows.select("host", "agent", "allow", compiled("pattern").alias("pattern"), F.length("pattern").alias("size"), "delay")


def judged(urls: DataFrame, known: DataFrame, url: str, agent: str, unknown: bool = False) -> DataFrame:
    """(url, allowed): the longest rule that fits decides, allow before disallow; the rules of the agent,
    else those of *; a host with rules of which none fits is open, one without any file is `unknown`."""
    rows = urls.select(url, F.regexp_extract(url, "://([^/?#]*)", 1).alias("host"), F.coalesce(F.nullif(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit("")), F.lit("/")).alias("path"))
    exact = known.where(F.col("agent") == agent)
    spare = known.where("agent = '*'").join(exact.select("host").distinct(), "host", "left_anti")
    applying = exact.unionByName(spare)
    hosts = known.select("host").distinct().withColumn("_known", F.lit(True))
    met = rows.join(applying, "host", "left")
    fits = (F.col("size") > 0) & F.rlike(F.col("path"), F.col("pattern"))
    best = lambda allow: F.coalesce(F.max(F.when(fits & (F.col("allow") == allow), F.col("size"))), F.lit(0))
    out = met.groupBy(url, "host").agg(best(True).alias("_a"), best(False).alias("_d")).join(hosts, "host", "left")
    verdict = F.when(F.col("_known").isNull(), F.lit(unknown)).otherwise((F.col("_a") >= F.col("_d")) | (F.col("_d") == 0))
    return out.select(url, verdict.alias("allowed"))
