"""Finding the customer an uploaded row belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.identifiers import NO_VALUE, UNKNOWN_DEDUCTOR, blank_to_null, code_of, key_of
from tallyfold.operators.joins import lookup_join

# Fixed value: identifiers in the order they are trusted.
MATCH_ORDER = ["code", "tan", "pan", "name"]


def customer_keys(customers: DataFrame) -> DataFrame:
    """(kind, key) -> customer; among customers sharing a key the last id."""
    keys = {
        "code": code_of(F.col("cust_code")),
        "tan": code_of(F.col("tan_number")),
        "pan": code_of(F.col("pan_number")),
        "name": key_of(F.col("cust_name")),
    }
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in keys.items()]))
    return (
        customers.select("cust_id", "cust_name", pairs.alias("_p"))
        .select("_p.kind", "_p.key", F.struct("cust_id", "cust_name").alias("who"))
        .filter(F.col("key") != "")
        .groupBy("kind", "key")
        .agg(F.max("who").alias("who"))
    )


def match_customers(rows: DataFrame, customers: DataFrame) -> DataFrame:
    """Adds cust_id and matched_name to rows with code, tan, pan and name;
    code wins over TAN, TAN over PAN, PAN over name, null when none hits.

    Identities are looked up, not rows: equal ones collapse before the first
    shuffle, so a customer with a third of the rows is looked up once.
    """
    keyed = rows.withColumns(
        {
            "_code": code_of(F.col("code")),
            "_tan": code_of(F.col("tan")),
            "_pan": code_of(F.col("pan")),
            "_name": key_of(F.col("name")),
        }
    )
    identity = ["_code", "_tan", "_pan", "_name"]
    tries = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("rank"), F.lit(k).alias("kind"), F.col(f"_{k}").alias("key"))
                for i, k in enumerate(MATCH_ORDER)
            ]
        )
    )
    found = (
        keyed.select(*identity)
        .distinct()
        .select(*identity, tries.alias("_t"))
        .select(*identity, "_t.rank", "_t.kind", "_t.key")
        .filter(F.col("key") != "")
        .join(customer_keys(customers), ["kind", "key"])
        .groupBy(*identity)
        .agg(F.min_by("who", "rank").alias("who"))
        .select(*identity, F.col("who.cust_id").alias("cust_id"), F.col("who.cust_name").alias("matched_name"))
    )
    return lookup_join(keyed, found, identity).drop(*identity)


def tan_by_name(customers: DataFrame) -> DataFrame:
    named = customers.select(
        key_of(F.col("cust_name")).alias("name_key"), "cust_id", "tan_number"
    ).filter((F.col("name_key") != "") & (F.coalesce("tan_number", F.lit("")) != ""))
    return named.groupBy("name_key").agg(F.max_by("tan_number", "cust_id").alias("known_tan"))


def resolve_deductors(rows: DataFrame, customers: DataFrame) -> DataFrame:
    """Adds resolved_tan and final_name: a missing TAN, or one under an unknown
    deductor, is looked up by customer name, then by deductor name."""
    keyed = rows.withColumns(
        {
            "_cust": F.coalesce(key_of(F.col("customer_name")), F.lit("")),
            "_ded": F.coalesce(key_of(F.col("deductor_name")), F.lit("")),
        }
    )
    known = tan_by_name(customers)
    pairs = keyed.select("_cust", "_ded").distinct()
    found = (
        pairs.join(known.withColumnsRenamed({"name_key": "_cust", "known_tan": "_by_cust"}), "_cust", "left")
        .join(known.withColumnsRenamed({"name_key": "_ded", "known_tan": "_by_ded"}), "_ded", "left")
        .select("_cust", "_ded", F.coalesce("_by_cust", "_by_ded").alias("_known"))
    )
    tan = blank_to_null(F.col("deductor_tan"))
    missing = tan.isNull() | (tan == NO_VALUE) | (F.col("_ded") == UNKNOWN_DEDUCTOR.lower())
    resolved = F.when(missing, F.coalesce("_known", F.lit(NO_VALUE))).otherwise(tan)
    name = blank_to_null(F.col("deductor_name"))
    final = F.when(name.isNull() | (name == UNKNOWN_DEDUCTOR), F.col("customer_name")).otherwise(name)
    joined = lookup_join(keyed, found, ["_cust", "_ded"])
    return joined.withColumns({"resolved_tan": resolved, "final_name": final}).drop("_cust", "_ded", "_known")
