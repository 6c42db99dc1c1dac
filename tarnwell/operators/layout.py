"""Page layout: words to lines, images in place, one text per document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tarnwell.operators.ranking import top_n

# Margin band and smallest image side.
MARGIN_SHARE = 0.08
MIN_IMAGE_SIDE = 50.0


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _line_numbers(heights: pa.Array, tolerance: pa.Array) -> pa.Array:
    """The number of the line of each word of a page, from 1 by height; 0 for a word without a height."""
    found = np.zeros(len(heights.flatten()), np.int32)
    at = 0
    for page, far in zip(heights, tolerance.to_pylist()):
        held = np.arange(at, at + len(page.values))
        at += len(held)
        held = held[pc.is_valid(page.values).to_numpy(zero_copy_only=False)]
        ys = page.values.drop_null().to_numpy(zero_copy_only=False)
        places = np.unique(ys)
        anchors, low = [], None
        for place, whole in zip(places.tolist(), np.clip(np.nan_to_num(np.floor(places), posinf=np.inf, neginf=-np.inf), -(2.0**63), 2.0**63).tolist()):
            # No number is a height above all others.
            if low is None or place != place or place - low >= far:
                anchors.append(place)
                low = whole
        found[held] = np.searchsorted(anchors, ys, side="right")
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(pc.list_value_length(heights).to_numpy())), pa.int32()), pa.array(found))


def words_to_lines(words: DataFrame, keys: list[str], tolerance: float = 5.0) -> DataFrame:
    """Words (keys, x, y, text) grouped into lines; a line has mean y and least x.

    A word belongs to the line above it if it lies less than ``tolerance`` below the whole part of the line's first
    word; a line does not drift with its words. The words of one page meet in one task, where its cost grows with their number.
    """
    pages = words.groupBy(*keys).agg(F.collect_list(F.struct("x", F.col("y").cast("double").alias("y"), "text")).alias("_words"))
    heights = F.transform("_words", lambda w: w["y"])
    numbered = pages.withColumn("_lines", _line_numbers(heights, F.lit(float(tolerance))))
    placed = F.zip_with("_lines", "_words", lambda n, w: F.struct(n.alias("line"), w["x"].alias("x"), w["y"].alias("y"), w["text"].alias("text")))
    # Sorted by line and then as a line is read, so a line is a slice that begins where the number changes.
    ordered = numbered.select(*keys, F.sort_array(placed).alias("_words"))
    begins = F.filter(F.transform("_words", lambda w, i: F.when((i == 0) | (w["line"] != F.get("_words", i - 1)["line"]), i + 1)), lambda i: i.isNotNull())
    cut = ordered.withColumn("_begins", begins)
    slices = F.transform("_begins", lambda b, k: F.slice("_words", b, F.coalesce(F.get("_begins", k + 1), F.size("_words") + 1) - b))
    lines = cut.select(*keys, F.explode(slices).alias("_line"))
    ys = F.filter(F.col("_line.y"), lambda y: y.isNotNull())
    mean = F.when(F.size(ys) > 0, F.aggregate(ys, F.lit(0.0), lambda acc, y: acc + y) / F.size(ys))
    return lines.select(*keys, mean.alias("y"), F.array_min("_line.x").alias("x"), F.array_join("_line.text", " ").alias("content"))


def filter_margin_images(images: DataFrame, margin: float = MARGIN_SHARE, min_side: float = MIN_IMAGE_SIDE) -> DataFrame:
    """Images outside the header and footer bands that are neither tiny nor decorative."""
    centre = (F.col("y0") + F.col("y1")) / 2 / F.col("page_height")
    tiny = (F.col("x1") - F.col("x0") < min_side) & (F.col("y1") - F.col("y0") < min_side)
    return images.where(
        ~tiny & F.col("has_content") & ~F.col("is_decorative")
        & ((F.col("page_height") <= 0) | F.col("page_height").isNull() | centre.between(margin, 1 - margin))
    )


def cap_per_doc(images: DataFrame, keys: list[str], order: list[Column], n: int = 50) -> DataFrame:
    return top_n(images, keys, order, n)


def merge_layout(elements: DataFrame, keys: list[str], default_gap: float = 15.0, factor: float = 1.5) -> DataFrame:
    """One text per key: elements in (y, x) order, a blank line where the gap is wide.

    ``elements``: keys, y, x, content, is_image. The usual gap is the mean distance of the text
    lines; because gaps between sorted values add up, it is (last - first) / (count - 1).
    """
    span = W.partitionBy(*keys)
    placed = elements.withColumn("content", F.trim("content")).where(F.col("content") != "")
    text_y = F.when(~F.col("is_image"), F.col("y"))
    sized = elements.groupBy(*keys).agg(
        F.count(text_y).alias("_lines"), F.min(text_y).alias("_top"), F.max(text_y).alias("_bottom")
    )
    usual = F.when(F.col("_lines") >= 2, (F.col("_bottom") - F.col("_top")) / (F.col("_lines") - 1)).otherwise(F.lit(default_gap))
    ordered = span.orderBy("y", "x", "is_image", "content")
    joined = (
        placed.join(sized, keys)
        .withColumn("_gap", F.col("y") - F.lag("y").over(ordered))
        .withColumn("_place", F.row_number().over(ordered))
    )
    lead = F.when(F.col("_gap").isNull(), "").when(F.col("_gap") > usual * factor, "\n\n").otherwise(" ")
    parts = F.array_sort(F.collect_list(F.struct(F.col("_place").alias("p"), F.concat(lead, F.col("content")).alias("t"))))
    return joined.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("content"))


def join_pages(pages: DataFrame, doc: str, page: str = "page_no", rule: str = "\n\n---\n\n") -> DataFrame:
    """Pages of a document in order, separated by a rule line."""
    parts = F.array_sort(F.collect_list(F.struct(page, "content")))
    return pages.where(F.col("content") != "").groupBy(doc).agg(F.array_join(F.transform(parts, lambda p: p["content"]), rule).alias("content"))


def format_image_description(
    text: Column, has_content: Column, is_decorative: Column, content_type: Column, is_action: Column, has_instructions: Column,
    extracted: Column, action: Column, shows_result: Column, ui_elements: Column,
) -> Column:
    """Plain text of an image description, by what the image is for."""
    elements = F.array_join(F.slice(F.coalesce(ui_elements, F.array().cast("array<string>")), 1, 5), ", ")
    with_text = F.when((text != "") & (F.lower(text) != F.lower(action)), F.concat(F.lit(" "), text)).otherwise("")
    options = F.when(elements != "", F.concat(F.lit(" Options available: "), elements)).otherwise("")
    listed = F.when(elements != "", F.concat(F.lit(" (UI elements: "), elements, F.lit(")"))).otherwise("")
    return (
        F.when(~has_content | is_decorative, "")
        .when(has_instructions & (F.coalesce(extracted, F.lit("")) != ""), F.trim(extracted))
        .when(is_action & (F.coalesce(action, F.lit("")) != ""), F.concat(F.lit("[Action: "), action, F.lit("]"), with_text))
        .when(shows_result, F.concat(F.lit("[Result: "), text, F.lit("]")))
        .when(content_type == "dialog_box", F.concat(F.lit("[Dialog: "), text, options, F.lit("]")))
        .otherwise(F.concat(F.lit("[Image: "), text, F.lit("]"), listed))
    )


def fallback_description(alt: Column) -> Column:
    return F.when(F.coalesce(alt, F.lit("")) != "", F.concat(F.lit("[Image: "), alt, F.lit("]"))).otherwise("[Image: Visual content]")


def sanitise_description(text: Column) -> Column:
    """One line without square brackets, double quotes, back-ticks and backslashes."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.translate(flat, '[]`"\\', "()''")
