"""Ownership-network tables derived from the TPC-H-style test tables.

Ids are strings with a kind prefix: ``O<n>`` a company (an order), ``C<n>`` /
``S<n>`` a person (a customer / a supplier).  Every table is a lazy
projection of the parquet inputs, so only the needed columns are scanned.

The rules below are fixed values of the shared test fixture; the DuckDB
oracle builds the same tables from the same inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshscope.sources import schemas as S


def _table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def _id(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), key.cast("string"))


def _d(value: float | None) -> Column:
    return F.lit(value).cast("double")


def _edge(company: Column, owner: Column, capital: Column, profit: Column, there: Column) -> Column:
    return F.struct(
        company.alias(S.COMPANY),
        owner.alias(S.OWNER),
        capital.cast("double").alias(S.CAPITAL),
        profit.cast("double").alias(S.PROFIT),
        there.alias("_there"),
    )


def _edges(df: DataFrame, *parts: Column) -> DataFrame:
    """The edges that each row of one scan stands for."""
    return df.select(F.inline(F.array(*parts))).filter("_there").drop("_there")


def ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw ownership edges (with duplicates, zero and NULL shares, chains, cycles).

    Fixed fixture rules (UNION ALL):
      a. every lineitem: O<l_orderkey> owned by S<l_suppkey>; capital 0 when
         l_linenumber = 7 else l_quantity; profit 0 when l_linenumber = 7 or
         l_discount = 0 else l_quantity
      b. lineitem with l_linenumber = 1 and l_orderkey % 5 = 0, again: capital
         l_quantity; profit 0 when l_discount = 0 else l_quantity
      c. every order: O<o_orderkey> owned by C<o_custkey>, 20 / 20
      d. orders with o_orderkey % 12 <> 0: owned by O<o_orderkey - 1>, 10 / 10
      e. orders with o_orderkey % 240 = 0: owned by O<o_orderkey + 1>, 5 / 5
      f. orders with o_orderkey % 500 = 1: owned by 'S0', NULL / NULL
      g. orders with o_orderkey % 400 = 0: G<o_orderkey> owned by 'P1', 100 / 100
    """
    li = _table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_linenumber",
                "l_quantity", "l_discount")
    od = _table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    key, qty = F.col("o_orderkey"), F.col("l_quantity")
    company_l, owner_l = _id("O", F.col("l_orderkey")), _id("S", F.col("l_suppkey"))
    company_o = _id("O", key)
    last, no_discount = F.col("l_linenumber") == 7, F.col("l_discount") == 0
    zero, none = _d(0.0), _d(None)
    every = F.lit(True)
    lines = _edges(
        li,
        _edge(company_l, owner_l, F.when(last, zero).otherwise(qty),
              F.when(last | no_discount, zero).otherwise(qty), every),
        _edge(company_l, owner_l, qty, F.when(no_discount, zero).otherwise(qty),
              (F.col("l_linenumber") == 1) & (F.col("l_orderkey") % 5 == 0)),
    )
    orders = _edges(
        od,
        _edge(company_o, _id("C", F.col("o_custkey")), _d(20.0), _d(20.0), every),
        _edge(company_o, _id("O", key - 1), _d(10.0), _d(10.0), key % 12 != 0),
        _edge(company_o, _id("O", key + 1), _d(5.0), _d(5.0), key % 240 == 0),
        _edge(company_o, F.lit("S0"), none, none, key % 500 == 1),
        _edge(_id("G", key), F.lit("P1"), _d(100.0), _d(100.0), key % 400 == 0),
    )
    return lines.unionByName(orders)


def seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Person scores.

    Fixed fixture rules: C<c_custkey> -> (c_custkey % 101) / 100 for
    c_custkey % 50 <> 7; S<s_suppkey> -> (s_suppkey % 97) / 100 for
    s_suppkey % 100 <> 13 (division in DOUBLE); 'P1' -> 1.
    """
    cu = _table(spark, sf_dir, "customer", "c_custkey")
    su = _table(spark, sf_dir, "supplier", "s_suppkey")
    persons_c = cu.filter(F.col("c_custkey") % 50 != 7).select(
        _id("C", F.col("c_custkey")).alias(S.TAXPAYER),
        ((F.col("c_custkey") % 101).cast("double") / 100.0).alias(S.SEED_VALUE))
    persons_s = su.filter(F.col("s_suppkey") % 100 != 13).select(
        _id("S", F.col("s_suppkey")).alias(S.TAXPAYER),
        ((F.col("s_suppkey") % 97).cast("double") / 100.0).alias(S.SEED_VALUE))
    holder = spark.range(1).select(F.lit("P1").alias(S.TAXPAYER), F.lit(1.0).alias(S.SEED_VALUE))
    return persons_c.unionByName(persons_s).unionByName(holder)


def family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family relations: a few per person, whatever the size of the tables.

    Fixed fixture rules: supplier s: (S<s>, S<s + 1>, 'NEXT'); (S<s>, S<s + 7>,
    'NEXT') for s % 3 = 0; (S<s>, S<s>, 'SELF') for s % 10 = 0 (self-relations
    that consumers must drop).  Customer c: (C<c>, S<c div 15 + 1>, 'CLIENT');
    (C<c>, 'S1', 'HUB') for c % 20 = 0 (one person with very many relatives).
    """
    su = _table(spark, sf_dir, "supplier", "s_suppkey")
    cu = _table(spark, sf_dir, "customer", "c_custkey")
    s, c = F.col("s_suppkey"), F.col("c_custkey")

    def relation(a: Column, b: Column, kind: str, there: Column) -> Column:
        return F.struct(a.alias(S.TAXPAYER), b.alias(S.RELATIVE),
                        F.lit(kind).alias(S.RELATION_TYPE), there.alias("_there"))

    suppliers = _edges(
        su,
        relation(_id("S", s), _id("S", s + 1), "NEXT", F.lit(True)),
        relation(_id("S", s), _id("S", s + 7), "NEXT", s % 3 == 0),
        relation(_id("S", s), _id("S", s), "SELF", s % 10 == 0),
    )
    customers = _edges(
        cu,
        relation(_id("C", c), _id("S", F.floor(c / 15) + 1), "CLIENT", F.lit(True)),
        relation(_id("C", c), F.lit("S1"), "HUB", c % 20 == 0),
    )
    return suppliers.unionByName(customers)


def known_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known economic groups.

    Fixed fixture rules: (O<o_orderkey>, o_orderpriority) for
    o_orderkey % 500 = 0, plus five ids X0..X4 with label 'none' that match
    no company.
    """
    od = _table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority")
    known = od.filter(F.col("o_orderkey") % 500 == 0).select(
        _id("O", F.col("o_orderkey")).alias(S.GROUP_ID), F.col("o_orderpriority").alias(S.GROUP_LABEL))
    unmatched = spark.range(5).select(_id("X", F.col("id")).alias(S.GROUP_ID),
                                      F.lit("none").alias(S.GROUP_LABEL))
    return known.unionByName(unmatched)
