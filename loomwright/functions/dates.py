"""Local times, as-of days and period keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwright.session import instant


def local_time(col: Column, zone: str = "Asia/Shanghai", missing: str = "暂无记录", invalid: str = "时间无效") -> Column:
    """An ISO instant as YYYY-MM-DD HH:mm in a zone; labels for null or '' and for what is no time. The session runs in UTC."""
    shown = F.date_format(F.from_utc_timestamp(instant(col), zone), "yyyy-MM-dd HH:mm")
    return F.when(col.isNull() | (col == ""), missing).otherwise(F.coalesce(shown, F.lit(invalid)))


def as_of_day(at: Column, zone: str = "Asia/Shanghai", closes: int = 16) -> Column:
    """The last finished day at an instant: today once the local hour is ``closes``, else yesterday."""
    local = F.from_utc_timestamp(at, zone)
    return F.when(F.hour(local) >= closes, F.to_date(local)).otherwise(F.date_sub(F.to_date(local), 1))


def month_key(at: Column) -> Column:
    """YYYY-MM of an instant."""
    return F.date_format(at, "yyyy-MM")


def day_distance(later: Column, earlier: Column) -> Column:
    """Whole days between two dates."""
    return F.datediff(later, earlier)


def config_digest(config: dict) -> str:
    """SHA-256 of a configuration, whatever the order of its keys: what a checkpoint is valid for."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def label(col: Column, labels: dict[str, str]) -> Column:
    """The label of a code; the code itself where it has none."""
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(known, col), col)
