"""Pages and paths: text, title and links of HTML, kinds of files, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators import prefixes

DROPPED = ("script", "style", "nav", "footer", "header", "noscript")
# fixed values: extensions by kind
ASSET_KINDS = {"drawing": ("dwg", "dxf"), "video": ("mp4", "avi", "mov"), "image": ("png", "jpg", "jpeg"), "audio": ("mp3", "wav")}
# fixed values: networks that no crawl may reach
BLOCKED = (
    "127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "0.0.0.0/8", "100.64.0.0/10", "192.0.0.0/24", "198.18.0.0/15",
    "::1/128", "fc00::/7", "fe80::/10",
)


def text_of(html: Column) -> Column:
    """Lines of more than two characters, without scripts, styles, navigation and tags."""
    parts = "|".join(f"<{x}[^>]*>.*?</{x}>" for x in DROPPED)
    plain = F.regexp_replace(F.regexp_replace(html, f"(?is){parts}", " "), "(?s)<[^>]+>", "\n")
    lines = F.transform(F.split(F.replace(plain, F.lit("&nbsp;"), F.lit(" ")), "\n"), lambda x: F.btrim(F.regexp_replace(x, "[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: F.length(x) > 2), "\n")


def title_of(html: Column) -> Column:
    return F.btrim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, link, same_host, is_pdf): absolute links without query or fragment, each once."""
    href = F.explode(F.regexp_extract_all("html", F.lit('(?i)href="([^"]+)"'), F.lit(1)))
    found = pages.select("page_id", "url", href.alias("href")).where(F.startswith("href", F.lit("/")) | F.startswith("href", F.lit("http")))
    root = F.regexp_extract("url", "^(https?://[^/]+)", 1)
    whole = F.when(F.startswith("href", F.lit("/")), F.concat(root, "href")).otherwise(F.col("href"))
    bare = F.regexp_replace(whole, "[?#].*$", "")
    host = lambda x: F.regexp_extract(x, "^https?://([^/]+)", 1)
    return found.select("page_id", bare.alias("link"), (host(whole) == host(F.col("url"))).alias("same_host"), F.lower(bare).rlike(r"\.pdf$").alias("is_pdf")).distinct()


def asset_kind(ext: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, exts in ASSET_KINDS.items():
        out = F.when(ext.isin(*exts), kind).otherwise(out)
    return F.coalesce(out, F.lit("other"))


def safe_ratio(unpacked: Column, packed: Column, most: int = 200) -> Column:
    """The guard against archives that swell."""
    return unpacked / packed <= most


def blocked(rows: DataFrame, address: str, networks: DataFrame) -> DataFrame:
    """``rows`` with ``blocked``: whether the literal address (v4 or v6) lies in one of ``networks`` (network); null if it is no address."""
    bits, out = F.col("__bits"), rows.withColumn("__bits", prefixes.address_bits(F.col(address)))
    nets = networks.select(prefixes.network_bits(F.col("network")).alias("prefix"))
    found = prefixes.longest(out, "__bits", nets, "__net")
    return found.withColumn("blocked", F.when(bits.isNotNull(), F.col("__net").isNotNull())).drop("__bits", "__net")


def shortcut_hosts(files: DataFrame) -> DataFrame:
    """(host, n): how many shortcuts (content: text of .url files) lead to each host; what names none does not count."""
    url = F.regexp_extract("content", r"(?im)^URL=\s*(\S+)", 1)
    host = F.lower(F.regexp_extract(url, r"^https?://(?:[^/@]*@)?([^/:?#]+)", 1))
    return files.select(host.alias("host")).where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"))
