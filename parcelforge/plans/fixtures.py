"""Land-record inputs derived from the test tables.

The test tables have no geometry.  Boxes, attributes and decisions follow from integer keys by arithmetic that reads
the same in Spark SQL and in DuckDB, so one text serves as the input of both.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def D(x) -> str:  # noqa: N802
    return f"cast({x} as double)"


def _choice(expr: str, values: list[str | None]) -> str:
    arms = " ".join(f"when {k} then {'null' if v is None else repr(v)}" for k, v in enumerate(values))
    return f"case {expr} {arms} end"


LAND_A = ["Residential", "Agricultural", "Commercial", "Industrial", "Public school", "Forest", "Vacant plot"]
LAND_B = ["housing", "farm land", "retail shop", "warehouse", "hospital", "green park", None]
K = "p_partkey"

PARCELS = f"""
select a_id, a_x1, a_y1, a_x1 + {D("0.0008")} as a_x2, a_y1 + {D("0.0006")} as a_y2, a_parcel, a_owner, a_land_use, a_area, a_mutation, a_risk, a_survey from (
select {K} as a_id,
  {D("73.85")} + ({K} % 40) * {D("0.00095")} as a_x1, {D("18.52")} + floor({K} / {D(40)}) * {D("0.00075")} as a_y1,
  concat('CP-', cast({K} as varchar(20))) as a_parcel, p_brand as a_owner,
  {_choice(f"cast({K} % 7 as int)", LAND_A)} as a_land_use,
  case when {K} % 5 = 0 then null else round({D(5600)} * (1 + ({K} % 11) * {D("0.005")}), 2) end as a_area,
  {_choice(f"cast({K} % 6 as int)", ["Approved", "Pending", "registered", "Disputed", "", None])} as a_mutation,
  {_choice(f"cast({K} % 9 as int)", ["High", "Low", "moderate", "severe flood", "low", "low", "low", None, "amber"])} as a_risk,
  case when {K} % 9 = 0 then null else concat('S/', cast({K} % 500 as varchar(20))) end as a_survey
from part) q
"""

_BASE = f"""
select {K} as k, {D("73.85")} + ({K} % 40) * {D("0.00095")} + {D("0.0004")} as mx, {D("18.52")} + floor({K} / {D(40)}) * {D("0.00075")} + {D("0.0003")} as cy,
  (({K} * 7) % 11 - 5) * {D("0.00002")} as dx, {D("0.6")} + {D("0.04")} * ({K} % 10) as sc,
  case when {K} % 17 = 0 then {D(0)} else {D("0.9")} end as att from part where {K} % 13 <> 0
"""

STRUCTURES = f"""
select b_id, b_k, b_att, cx - {D("0.0004")} * sc as b_x1, cy - {D("0.0003")} * sc as b_y1, cx + {D("0.0004")} * sc as b_x2, cy + {D("0.0003")} * sc as b_y2,
  concat('DS-', cast(b_id as varchar(20))) as b_structure,
  case when b_k % 17 = 0 then {_choice("cast((b_k + 3) % 7 as int)", LAND_B)} else {_choice("cast(b_k % 7 as int)", LAND_B)} end as b_land_use,
  case when b_k % 4 = 0 then null else round({D(5600)} * sc * sc, 2) end as b_area,
  {_choice("cast(b_k % 5 as int)", ["Approved", "pending", "sanctioned", None, "court stay"])} as b_mutation,
  {_choice("cast(b_k % 4 as int)", ["low", "High", None, "moderate"])} as b_risk,
  case when b_k % 19 = 0 then concat('S/X', cast(b_k as varchar(20))) else concat('S/', cast(b_k % 500 as varchar(20))) end as b_survey
from (select k * 2 as b_id, k as b_k, mx + dx as cx, cy, sc, att as b_att from base
  union all select k * 2 + 1, k, mx - dx, cy, sc, att from base where k % 29 = 0) q
"""

#: Points: an asset for each supplier.
ASSETS = f"""
select s_suppkey as id, s_name as name, {D("73.85")} + (s_suppkey % 37) * {D("0.001")} + {D("0.00013")} as x, {D("18.52")} + floor(s_suppkey / {D(37)}) * {D("0.0008")} + {D("0.00017")} as y, s_acctbal as balance from supplier
"""

#: Decisions: an order decides the record of the parcel of its number, where it is not open.
DECISIONS = f"""
select o_orderkey as parcel, case when o_orderkey % 4 = 0 then 'ACCEPT_SOURCE_A' when o_orderkey % 4 = 1 then 'ACCEPT_SOURCE_B' when o_orderkey % 4 = 2 then 'MERGE_RECONCILE' else 'REJECT_UNRESOLVED' end as action,
  o_orderdate as decided_at, case when o_orderkey % 8 = 2 then round(o_totalprice, 2) end as chosen_area from orders where o_orderstatus <> 'O'
"""

#: The second version of the parcels: some are gone, some are new, some have moved or changed.
VERSION_2 = f"""
select {K} + case when {K} % 23 = 0 then 100000000 else 0 end as id, {D("73.85")} + ({K} % 40) * {D("0.00095")} + case when {K} % 31 = 0 then {D("0.00003")} else {D(0)} end as x1,
  {D("18.52")} + floor({K} / {D(40)}) * {D("0.00075")} as y1, {D("73.85")} + ({K} % 40) * {D("0.00095")} + {D("0.0008")} + case when {K} % 31 = 0 then {D("0.00003")} else {D(0)} end as x2,
  {D("18.52")} + floor({K} / {D(40)}) * {D("0.00075")} + {D("0.0006")} as y2, case when {K} % 37 = 0 then 'Changed' else p_brand end as owner, p_type as kind from part
"""
VERSION_1 = f"""
select {K} as id, {D("73.85")} + ({K} % 40) * {D("0.00095")} as x1, {D("18.52")} + floor({K} / {D(40)}) * {D("0.00075")} as y1, {D("73.85")} + ({K} % 40) * {D("0.00095")} + {D("0.0008")} as x2,
  {D("18.52")} + floor({K} / {D(40)}) * {D("0.00075")} + {D("0.0006")} as y2, p_brand as owner, p_type as kind from part
"""

#: Attribute values of three sources: (record_id, attribute, source, value).
VALUES = f"""
select o_orderkey as record_id, 'owner_name' as attribute, 'cadastral registry' as source, c_name as value from orders join customer on o_custkey = c_custkey
union all select o_orderkey, 'owner_name', 'municipal assets', case when o_orderkey % 3 = 0 then upper(c_name) when o_orderkey % 3 = 1 then concat(c_name, ' Ltd') end from orders join customer on o_custkey = c_custkey
union all select o_orderkey, 'area_sqm', 'cadastral registry', cast(cast(o_totalprice as decimal(12, 0)) as varchar(20)) from orders
union all select o_orderkey, 'area_sqm', 'drone ortho', cast(cast(o_totalprice * (1 + (o_orderkey % 9) * {D("0.01")}) as decimal(12, 0)) as varchar(20)) from orders
"""

#: An audit log: the stage is the user's number, the status the kind of event.
RUNS = "select cast(user_id % 14 + 1 as int) as stage, event_id as run_id, case when event_id % 5 = 0 then 'failed' else 'completed' end as status, ts as completed_at from events"

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "conversations")


def tables(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def frame(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The frame of one of the texts above over the test tables it names."""
    inputs = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in TABLES if re.search(rf"\b(from|join) {n}\b", text)}
    if " base" in text:
        inputs["base"] = spark.sql(_BASE.replace("from part", "from {part}"), part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    body = text
    for n in inputs:
        body = re.sub(rf"\b(from|join) {n}\b", rf"\1 {{{n}}}", body)
    return spark.sql(body, **inputs)
