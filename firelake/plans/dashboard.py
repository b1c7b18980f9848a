"""The map view: prepared events, form filters, and what is shown about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firelake.operators.filters import filter_confidence_normalized, filter_min_brightness_frp
from firelake.operators.ordering import newest_first
from firelake.plans.serving import project_prepared
from firelake.schemas import RESULT_LIMIT


def prepare_list(records: DataFrame) -> DataFrame:
    """Prepared events of the newest records, each id ending in its place in the list.

    The list is cut at the result cap first, so its numbering runs over that many rows.
    """
    order = newest_first(("lat", "lon", "brightness", "frp"))
    shown = records.orderBy(*order).limit(RESULT_LIMIT)
    place = F.row_number().over(Window.orderBy(*order)) - 1
    return project_prepared(shown.withColumn("place", place), "place")


def apply_form(
    prepared: DataFrame, confidence: str = "all", min_brightness: object = 0, min_frp: object = 0
) -> DataFrame:
    """Events passing the filter form."""
    rows = filter_confidence_normalized(prepared, confidence)
    return filter_min_brightness_frp(rows, min_brightness, min_frp, brightness="brightness")
