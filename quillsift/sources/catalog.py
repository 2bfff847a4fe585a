"""Catalogs: product lines as JSON, and the given tables read as catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.functions import text as X
from quillsift.functions.attributes import attribute_values

#: Every field as it can come: texts, arrays and objects are read as they stand and made even afterwards.
RAW = "parent_asin string, title string, features string, description string, price string, categories string, details string, average_rating string, rating_number string, store string"


def as_array(raw):
    """An array of texts from a JSON array, an object's values or one text; null and empty give none."""
    parsed = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).when(raw.startswith("{"), F.map_values(F.from_json(raw, "map<string,string>")))
    plain = F.when(X.blank(raw) == "", F.lit([]).cast("array<string>")).otherwise(F.array(raw))
    return F.coalesce(parsed, plain)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Products from lines of JSON; blank lines are skipped and unknown fields ignored.

    parent_asin, title, categories, features (arrays), description, details (map), price (finite, or null), store,
    average_rating, rating_number. Missing and null fields are empty.
    """
    raw = spark.read.schema(RAW).json(path).where("parent_asin is not null")
    return raw.select(
        "parent_asin",
        X.joined(as_array(F.col("title"))).alias("title"),
        as_array(F.col("categories")).alias("categories"),
        as_array(F.col("features")).alias("features"),
        X.joined(as_array(F.col("description"))).alias("description"),
        F.coalesce(F.from_json("details", "map<string,string>"), F.lit(None).cast("map<string,string>"), F.map_from_arrays(F.lit([]).cast("array<string>"), F.lit([]).cast("array<string>"))).alias("details"),
        X.price(F.col("price")).alias("price"),
        X.joined(as_array(F.col("store"))).alias("store"),
        X.price(F.col("average_rating")).alias("average_rating"),
        X.whole_number(F.col("rating_number")).alias("rating_number"),
    )


def products(catalog: DataFrame) -> DataFrame:
    """catalog (as read_catalog() gives it) with all that ranking reads, normalised: one row for each product.

    doc_id, title, title120, categories, features, details, description, store (texts), price, rating_number,
    searchable, profile_text, attribute_text, attrs.
    """
    fields = catalog.select(
        F.col("parent_asin").alias("doc_id"), X.nfkc(X.blank(F.col("title"))).alias("title"), "categories", X.nfkc(X.joined(F.col("features"))).alias("features"),
        X.nfkc(X.map_values_text(F.col("details"))).alias("details"), X.nfkc(X.blank(F.col("description"))).alias("description"), X.nfkc(X.blank(F.col("store"))).alias("store"), "price", "rating_number",
    )
    return derived(fields)


def derived(fields: DataFrame) -> DataFrame:
    """Adds the texts and attributes that follow from a product's fields."""
    profile = F.concat_ws(" ", "title", "features", "details")
    every = F.concat_ws(" ", profile, "description")
    return (
        fields.withColumn("title120", F.substring("title", 1, 120))
        .withColumn("searchable", every)
        .withColumn("profile_text", profile)
        .withColumn("attribute_text", every)
        .withColumn("attrs", attribute_values(F.col("searchable"), F.col("features"), F.col("details"), F.col("price")))
    )


def part_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part table as products: name, type and brand as title, category and store, order lines as popularity."""
    sold = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_partkey").agg(F.count("*").alias("rating_number"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    none = F.lit("")
    fields = part.join(sold, part["p_partkey"] == sold["l_partkey"], "left").select(
        F.col("p_partkey").alias("doc_id"), X.blank(F.col("p_name")).alias("title"), F.array(X.blank(F.col("p_type"))).alias("categories"), none.alias("features"), none.alias("details"),
        none.alias("description"), X.blank(F.col("p_brand")).alias("store"), F.col("p_retailprice").alias("price"), F.coalesce("rating_number", F.lit(0)).alias("rating_number"),
    )
    return derived(fields)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, vector) in double precision."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vector"))
