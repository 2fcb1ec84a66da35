"""Item-list pages of the vendor feed: nested JSON to flat products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from colophon import constants as K
from colophon.functions.codes import blank_to_null, canonical_code
from colophon.functions.hashing import payload_hash
from colophon.functions.urls import url_or_null

_NAMED = "array<struct<id:string,name:string>>"
ITEM_FIELDS = (
    "content_id string, product_id string, title string, date string, URL string, URLsp string, affiliateURL string, "
    "affiliateURLsp string, description string, comment string, imageURL struct<large:string,small:string,list:string>, "
    "sampleImageURL struct<sample_l:struct<image:array<string>>,sample_s:struct<image:array<string>>>, "
    "sampleMovieURL struct<size_720_480:string,size_644_414:string,size_560_360:string,size_476_306:string>, "
    "prices struct<price:string>, review struct<count:string,average:string>, "
    f"iteminfo struct<actress:{_NAMED},maker:{_NAMED},series:{_NAMED},label:{_NAMED},genre:{_NAMED}>"
)
MOVIE_SIZES = ("size_720_480", "size_644_414", "size_560_360", "size_476_306")


def item_schema() -> T.StructType:
    return T._parse_datatype_string(ITEM_FIELDS)


def read_item_list(spark: SparkSession, path: str) -> DataFrame:
    """One row per item: ``page, position, raw, item``.

    ``raw`` is the item's text as it was received (its key order decides the payload hash);
    ``item`` is the typed struct.
    """
    pages = spark.read.option("wholetext", True).text(path).withColumn("page", F.col("_metadata.file_path"))
    return explode_items(pages.withColumnRenamed("value", "body"))


def explode_items(pages: DataFrame) -> DataFrame:
    """``pages(page, body)`` to one row per entry of ``result.items``."""
    items = F.get_json_object("body", "$.result.items")
    raws = F.from_json(items, "array<string>")
    rows = pages.select("page", F.posexplode(raws).alias("position", "raw"))
    return rows.withColumn("item", F.from_json("raw", item_schema()))


def _names(c: str) -> Column:
    return F.filter(F.transform(F.col(c), lambda x: blank_to_null(x["name"])), lambda x: x.isNotNull())


def _first_name(c: str) -> Column:
    return F.try_element_at(_names(c), F.lit(1))


def normalize_items(items: DataFrame, item: str = "item", raw: str = "raw") -> DataFrame:
    """Adds the flat product fields to item rows."""
    none = F.array().cast("array<string>")
    col = lambda path: F.col(f"{item}.{path}")
    code = canonical_code(F.coalesce(col("product_id"), col("content_id")))
    date = F.trim(col("date"))
    price = F.regexp_replace(col("prices.price"), "[^0-9.]", "")
    images = F.concat(F.coalesce(col("sampleImageURL.sample_l.image"), none), F.coalesce(col("sampleImageURL.sample_s.image"), none))
    large, small, listed = (url_or_null(col(f"imageURL.{s}")) for s in ("large", "small", "list"))
    out = items.withColumn("_code", code)
    return out.withColumns(
        {
            "external_product_id": F.coalesce(blank_to_null(col("content_id")), blank_to_null(col("product_id")), F.lit("")),
            "original_product_code": F.col("_code.original"),
            "product_code": F.col("_code.canonical"),
            "code_key": F.col("_code.key"),
            "code_rejection": F.when(F.col("_code.rejected"), F.lit(K.CODE_REJECTION)),
            "title": blank_to_null(col("title")),
            "performers": F.coalesce(_names(f"{item}.iteminfo.actress"), none),
            "maker": _first_name(f"{item}.iteminfo.maker"),
            "series": _first_name(f"{item}.iteminfo.series"),
            "label": _first_name(f"{item}.iteminfo.label"),
            "genres": F.coalesce(F.array_distinct(_names(f"{item}.iteminfo.genre")), none),
            "release_date": F.when(
                date.rlike("^[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}"), F.replace(F.substring(date, 1, 10), F.lit("/"), F.lit("-"))
            ),
            "description": F.coalesce(blank_to_null(col("description")), blank_to_null(col("comment"))),
            "card_image_url": F.coalesce(large, small, listed),
            "image_url": F.coalesce(large, listed, small),
            "sample_images": F.array_distinct(F.filter(F.transform(images, url_or_null), lambda x: x.isNotNull())),
            "video_url": F.coalesce(*[url_or_null(col(f"sampleMovieURL.{s}")) for s in MOVIE_SIZES]),
            "official_url": F.coalesce(url_or_null(col("URL")), url_or_null(col("URLsp"))),
            "affiliate_url": F.coalesce(url_or_null(col("affiliateURL")), url_or_null(col("affiliateURLsp"))),
            "price": F.when(price != "", price).try_cast("double"),
            "currency": F.lit("JPY"),
            "availability": F.lit("available"),
            "payload_hash": payload_hash(raw),
        }
    ).drop("_code")
