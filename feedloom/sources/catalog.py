"""Feed catalogue and the metadata carried by feed file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (category, data set, lake directory, variants). "V6" marks the IPv6 twin, "MMDB" a
# binary twin that is listed but not read.
FEEDS = [
    ("AI Data", "AIData", "ai", ["Latest", "Historical"]),
    ("Anonymous", "Anonymous", "anonymous", ["Latest", "Historical"]),
    ("Anonymous", "AnonymousIPv6", "anonymous-ipv6", ["IPv6 (Latest)", "IPv6 (Historical)"]),
    ("Anonymous", "Anonymous", "anonymous", ["MMDB (Latest)", "MMDB (Historical)"]),
    ("Anonymous+Residential", "AnonymousResidential", "anonymous-residential", ["Latest", "Historical"]),
    ("Anonymous+Residential", "AnonymousResidentialIPv6", "anonymous-residential-ipv6", ["IPv6 (Latest)", "IPv6 (Historical)"]),
    ("Anonymous+Residential", "AnonResRT", "anonymous-residential/realtime", ["Realtime (Latest)"]),
    ("Anonymous+Residential", "AnonymousResidentialRT", "anonymous-residential/realtime", ["Realtime (Historical)"]),
    ("Anonymous+Residential", "AnonymousResidential", "anonymous-residential", ["MMDB (Latest)", "MMDB (Historical)"]),
    ("Datacenter Hosting", "DCH", "dch", ["Latest", "Historical"]),
    ("IP Geo", "IPGeoJSON", "ipgeo", ["JSON Format (Latest)", "JSON Format (Historical)"]),
    ("IP Geo", "IPGeoMMDB", "ipgeo", ["MMDB Format (Latest)", "MMDB Format (Historical)"]),
    ("IP Summary", "IPSummary", "ipsummary", ["Latest", "Historical"]),
    ("Service Metrics", "ServiceMetricsAll", "service-metrics", ["Latest", "Historical"]),
    ("Similar IPs", "SimilarIPs", "similar-ips", ["Latest"]),
]

# Data set names recognised in file names.
DATASET_NAMES = (
    "AnonRes|AnonResRT|Anonymous|IPGeoMMDB|IPGeoJSON|ServiceMetricsAll|DCH|AnonymousIPv6|"
    "AnonymousResidentialIPv6|AnonymousResidential|AnonymousResidentialRT|IPSummary|SimilarIPs|AIData"
)
_FEED_FILE = rf"(?i)(\d{{8}})(\d{{6}})?({DATASET_NAMES})\.(json|mmdb|json\.gz)$"


def feed_catalog(spark: SparkSession) -> DataFrame:
    """(category, variant, dataset, path_template, format, is_historical); templates are lake paths."""
    rows = []
    for category, dataset, folder, variants in FEEDS:
        for variant in variants:
            historical = "Historical" in variant
            binary = "MMDB" in variant
            suffix = "mmdb" if binary else "json.gz"
            if not historical:
                leaf = f"latest.{suffix}"
            elif "Realtime" in variant:
                leaf = "{date}/{time}.json.gz"
            else:
                leaf = f"{{date}}/feed.{suffix}"
            rows.append((category, variant, dataset, f"{folder}/{leaf}", "mmdb" if binary else "jsonl", historical))
    schema = "category string, variant string, dataset string, path_template string, format string, is_historical boolean"
    return spark.createDataFrame(rows, schema)


def feed_path(template: str, date: str = "", time: str = "") -> str:
    """Lake path of one snapshot; dates are YYYYMMDD, times HHMM."""
    return template.replace("{date}", date).replace("{time}", time)


def _name(file: Column) -> Column:
    return F.element_at(F.split(file, "/"), -1)


def snapshot_info(file: Column) -> dict[str, Column]:
    """snapshot_date, snapshot_time and dataset read off a feed file name.

    An unknown name keeps what is left after the leading date and the extension; a bare date reads
    CustomFeed.
    """
    name = _name(file)
    known = name.rlike(_FEED_FILE)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    derived = F.regexp_replace(stem, r"^\d{8}(\d{6})?", "")
    derived = F.when(
        F.contains(derived, F.lit("AnonRes")) & ~F.contains(derived, F.lit("AnonResRT")),
        F.replace(derived, F.lit("AnonRes"), F.lit("AnonymousResidential")),
    ).otherwise(derived)
    derived = F.coalesce(F.nullif(derived, F.lit("")), F.lit("CustomFeed"))
    return {
        "snapshot_date": F.when(known, F.regexp_extract(name, _FEED_FILE, 1)),
        "snapshot_time": F.when(known, F.nullif(F.regexp_extract(name, _FEED_FILE, 2), F.lit(""))),
        "dataset": F.when(known, F.regexp_extract(name, _FEED_FILE, 3)).otherwise(derived),
    }


def file_date(file: Column, modified: Column) -> Column:
    """YYYYMMDD at the start of the file name, else the modification day."""
    lead = F.regexp_extract(_name(file), r"^(\d{8})", 1)
    return F.coalesce(F.nullif(lead, F.lit("")), F.date_format(modified, "yyyyMMdd"))
