"""robots.txt bodies to rules, and which rule an address falls under."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of a body that is taken at its word (fixed values).
MAX_LINES, MAX_RULES, MAX_PATTERN = 2000, 256, 512


def parse_robots(body: str | None) -> list[tuple[int, list[str], bool, str]]:
    """(group, agents, allow, pattern) of the rules of a body; an empty line or a new agent behind rules ends a group."""
    rules: list[tuple[int, list[str], bool, str]] = []
    agents: list[str] = []
    group, has_rules = 0, False
    for raw in (body or "").splitlines()[:MAX_LINES]:
        line = raw.split("#", 1)[0].strip()
        key, colon, value = line.partition(":")
        key, value = key.strip().lower(), " ".join(value.split())[:MAX_PATTERN]
        if not line or (key == "user-agent" and has_rules):
            agents, has_rules, group = [], False, group + 1
        if not colon or not value:
            continue
        if key == "user-agent":
            agents = [*agents, value.lower()]
        elif key in ("allow", "disallow") and agents and len(rules) < MAX_RULES:
            rules.append((group, agents, key == "allow", value))
            has_rules = True
    return rules


def robots_rules(df: DataFrame, domain: str, body: str) -> DataFrame:
    """(domain, grp, agent, allow, pattern, regex, weight) of robots bodies; a row for each agent of a rule."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, g, a, ok, p) for d, t in zip(b[domain], b[body]) for g, agents, ok, p in parse_robots(t) for a in agents]
            yield pd.DataFrame(rows, columns=["domain", "grp", "agent", "allow", "pattern"])

    rules = df.select(domain, body).mapInPandas(run, "domain string, grp int, agent string, allow boolean, pattern string")
    escaped = F.regexp_replace("pattern", r"([.+?^{}()|\[\]\\])", r"\\$1")
    weight = F.length(F.regexp_replace(F.regexp_replace("pattern", r"\*", ""), r"\$$", ""))
    return rules.withColumn("regex", F.concat(F.lit("(?i)^"), F.replace(escaped, F.lit("*"), F.lit(".*")))).withColumn("weight", weight)


def robots_allowed(urls: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """``urls`` (domain, path, ...) with ``allowed``: the longest matching rule of the agent's own groups, else of all
    agents' groups, wins, an allowing one among equals; without a rule all is allowed.  ``path`` holds the query."""
    mine = F.lit(agent.lower()).contains(F.col("agent")) & (F.col("agent") != "*")
    of = rules.withColumn("mine", mine).where("mine or agent = '*'")
    own = of.groupBy("domain").agg(F.max("mine").alias("own"))
    of = of.join(own, "domain").where("mine = own").select("domain", "allow", "regex", "weight").distinct()
    key = urls.select("domain", "path").distinct()
    best = key.join(of, "domain").where(F.expr("path rlike regex")).groupBy("domain", "path").agg(F.max(F.struct("weight", "allow")).alias("best"))
    return urls.join(best, ["domain", "path"], "left").withColumn("allowed", F.coalesce("best.allow", F.lit(True))).drop("best")
