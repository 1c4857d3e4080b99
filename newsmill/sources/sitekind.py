"""What a site is: the system that makes its pages, and the regional lists that it is on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Systems by a word of the generator or header, and by what their pages hold (fixed values).
SYSTEMS = {
    "wordpress": ("wordpress", ["/wp-content/", "/wp-includes/"]),
    "ghost": ("ghost", ["ghost-sdk", "ghost.io"]),
    "brightspot": ("brightspot", ["brightspot"]),
    "drupal": ("drupal", ["/sites/default/files/", "drupal-settings-json"]),
}
_GENERATOR = r"""(?i)<meta[^>]+name=["']generator["'][^>]+content=["']([^"']+)["']"""


def made_by(html: Column, powered_by: Column, path: Column) -> Column:
    """The names of the systems that a page shows, and ``path-scoped`` for a page that isn't a site's root."""
    page, told = F.lower(F.coalesce(html, F.lit(""))), F.concat_ws(" ", F.lower(F.regexp_extract(html, _GENERATOR, 1)), F.lower(powered_by))
    tests = [(name, F.exists(F.array(*[page.contains(s) for s in signs]), lambda x: x) | told.contains(word)) for name, (word, signs) in SYSTEMS.items()]
    return F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests], F.when(~path.isin("", "/"), F.lit("path-scoped"))))


def region_domains(files: DataFrame, content: str) -> DataFrame:
    """(region, last_updated, domain) of regional lists as JSON; files that are none give no row."""
    t = files.select(F.from_json(content, "region string, lastUpdated string, sourceCount int, domains array<string>").alias("f"))
    return t.select(F.col("f.region").alias("region"), F.col("f.lastUpdated").alias("last_updated"), F.explode("f.domains").alias("domain"))
