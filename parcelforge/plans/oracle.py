"""DuckDB SQL that each query is held against: plain joins over all pairs, no grid, no ranges."""

from __future__ import annotations

import re

from parcelforge.functions import text
from parcelforge.operators.attributes import AUTHORITY
from parcelforge.operators.harmonize import INCOMPATIBLE
from parcelforge.operators.review import STAGES
from parcelforge.plans import fixtures as fx


def _class(x: str, classes) -> str:
    v = f"lower(trim({x}))"
    none = ", ".join(f"'{w}'" for w in text.NO_VALUE)
    arms = " ".join("when " + " or ".join(f"contains({v}, '{w}')" for w in ws) + f" then '{name}'" for name, ws in classes)
    return f"case when {v} is null or {v} in ({none}) then null {arms} else upper({v}) end"


def _hav(x1: str, y1: str, x2: str, y2: str) -> str:
    return f"2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians({x2} - {x1}) / 2), 2))))"


_OVER = "(greatest(0.0::double, least(a_x2, b_x2) - greatest(a_x1, b_x1)) * greatest(0.0::double, least(a_y2, b_y2) - greatest(a_y1, b_y1)))"
_AA, _BA = "((a_x2 - a_x1) * (a_y2 - a_y1))", "((b_x2 - b_x1) * (b_y2 - b_y1))"
_IOU = f"least(1.0, {_OVER} / ({_AA} + {_BA} - {_OVER}))"
_CX = "(a_x1 + a_x2) / 2", "(a_y1 + a_y2) / 2", "(b_x1 + b_x2) / 2", "(b_y1 + b_y2) / 2"
_CENTRE = _hav(*_CX)
_TOUCH = "(a_x1 <= b_x2 and b_x1 <= a_x2 and a_y1 <= b_y2 and b_y1 <= a_y2)"
_HOLDS = "(a_x1 <= b_x1 and b_x2 <= a_x2 and a_y1 <= b_y1 and b_y2 <= a_y2)"
_HELD = "(b_x1 <= a_x1 and a_x2 <= b_x2 and b_y1 <= a_y1 and a_y2 <= b_y2)"
_GAP = f"sqrt(pow(greatest(0.0::double, greatest(a_x1 - b_x2, b_x1 - a_x2)) * 111320.0 * cos(radians({_CX[1]})), 2) + pow(greatest(0.0::double, greatest(a_y1 - b_y2, b_y1 - a_y2)) * 110540.0, 2))"
_SERIES = lambda area, lat: f"({area}) * (111132.92 - 559.82 * cos(2 * radians({lat}))) * (111412.84 * cos(radians({lat})))"
_METRIC = lambda area, lat: f"round(({area}) * 111320.0 * cos(radians({lat})) * 110540.0, 2)"

_LU = _class("source_land_use", text.LAND_USE), _class("candidate_land_use", text.LAND_USE)
_MU = _class("source_mutation", text.MUTATION), _class("candidate_mutation", text.MUTATION)
_RI = _class("source_risk", text.RISK), _class("candidate_risk", text.RISK)
_SEVERITY = "case severity when 'CRITICAL' then 1 when 'HIGH' then 2 when 'MEDIUM' then 3 when 'LOW' then 4 else 5 end"
_PAIRS_OUT = " or ".join(f"(lu_a = '{x}' and lu_b = '{y}') or (lu_a = '{y}' and lu_b = '{x}')" for x, y in INCOMPATIBLE)

CTE = {
    "parcels": fx.PARCELS,
    "base": fx._BASE,
    "structures": fx.STRUCTURES,
    "assets": fx.ASSETS,
    "points": "select id as b_id, x as b_x1, y as b_y1, x as b_x2, y as b_y2 from assets",
    "vals": fx.VALUES,
    "runs": fx.RUNS,
    "v1": fx.VERSION_1,
    "v2": fx.VERSION_2,
    # Joined on the cell of a structure's corner, which is in exactly one; no structure is as wide as a cell.
    "near_": f"""select * exclude (cx, cy, bx, by_), {_GAP} as distance from
      (select *, unnest(range(floor((a_y1 - 0.002) / 0.001)::bigint, floor((a_y2 + 0.001) / 0.001)::bigint + 1)) as cy from
        (select *, unnest(range(floor((a_x1 - 0.002) / 0.001)::bigint, floor((a_x2 + 0.001) / 0.001)::bigint + 1)) as cx from parcels)) join
      (select *, floor(b_x1 / 0.001)::bigint as bx, floor(b_y1 / 0.001)::bigint as by_ from structures) on cx = bx and cy = by_
      and a_x1 - 0.001 <= b_x2 and a_x2 + 0.001 >= b_x1 and a_y1 - 0.001 <= b_y2 and a_y2 + 0.001 >= b_y1""",
    "pairs": f"""select *, coalesce(round({_OVER} / nullif(least({_AA}, {_BA}), 0) * 100, 1), 0) as overlap_pct, {_TOUCH} as is_intersecting, {_HOLDS} as is_containing,
      case when {_HOLDS} or {_HELD} then 'CONTAINMENT' when {_TOUCH} then 'OVERLAP' else 'PROXIMITY' end as relationship from near_ where distance <= 50""",
    "signals": f"""select *, {_IOU} as spatial, least({_AA}, {_BA}) / greatest({_AA}, {_BA}) as area, {_CENTRE} as centroid_m, greatest(0.0::double, 1 - {_CENTRE} / 50) as centroid,
      {_IOU} as geometry, case when a_id = b_k then b_att else 0.1::double end as attribute from pairs""",
    "score_": "select *, round(0.35 * spatial + 0.20 * area + 0.20 * centroid + 0.15 * geometry + 0.10 * attribute, 4)::double as score from (select * replace (spatial::double as spatial, area::double as area, centroid::double as centroid) from signals)",
    "scored": """select *, case when (spatial >= 0.5 or centroid >= 0.7) and (attribute < 0.25 or area < 0.35) then 'conflict' when score >= 0.8 then 'matched' when score >= 0.6 then 'possible_match'
      when score >= 0.4 and (spatial >= 0.5 or centroid >= 0.7) then 'conflict' else 'unmatched' end as status from score_""",
    "rank_": """select *, row_number() over (partition by a_id order by score desc, b_id desc) as rank, count(*) over (partition by a_id) as candidate_count, max(score) over (partition by a_id) as top,
      nth_value(score, 2) over (partition by a_id order by score desc, b_id desc rows between unbounded preceding and unbounded following) as second from scored""",
    "gap_": "select *, round(top - second, 4) as score_gap from rank_",
    "role_": """select *, case when candidate_count >= 2 and score_gap <= 0.015 and top >= 0.6 then case when round(top - score, 4) <= 0.015 then 'AMBIGUOUS' else 'SECONDARY' end
      when rank = 1 then case status when 'conflict' then 'CONFLICT' when 'unmatched' then 'UNMATCHED' else 'BEST' end when status = 'conflict' then 'CONFLICT' else 'SECONDARY' end as role from gap_""",
    "ranked": "select *, role = 'BEST' as is_best from role_",
    "best_": "select * from (select *, row_number() over (partition by a_id order by is_best desc, score desc, rank) as pick from ranked) where pick = 1",
    "area_": f"select *, coalesce(case when a_area > 0 then round(a_area, 2) end, {_METRIC(_AA, _CX[1])}) as source_area, coalesce(case when b_area > 0 then round(b_area, 2) end, {_METRIC(_BA, _CX[3])}) as candidate_area from best_",
    "field_": """select *, a_id || '_' || b_id as record_id, round(abs(source_area - candidate_area) / greatest(source_area, candidate_area) * 100, 2) as area_pct,
      nullif(trim(a_land_use), '') as source_land_use, nullif(trim(b_land_use), '') as candidate_land_use, nullif(trim(a_mutation), '') as source_mutation, nullif(trim(b_mutation), '') as candidate_mutation,
      nullif(trim(a_risk), '') as source_risk, nullif(trim(b_risk), '') as candidate_risk, nullif(trim(a_survey), '') as source_survey, nullif(trim(b_survey), '') as candidate_survey from area_""",
    "count_": """select *, coalesce(source_land_use, candidate_land_use) as land_use, coalesce(source_mutation, candidate_mutation) as mutation, coalesce(candidate_risk, source_risk) as risk, source_area as harmonized_area,
      case when spatial >= 0.85 then 'CONGRUENT' when spatial >= 0.5 then 'BOUNDARY_VARIANCE_RECONCILED' else 'AUTHORITATIVE_SELECTED' end as geometry_status,
      coalesce((lower(source_land_use) <> lower(candidate_land_use))::int, 0) + (area_pct > 5)::int + coalesce((lower(source_mutation) <> lower(candidate_mutation))::int, 0) + coalesce((lower(source_risk) <> lower(candidate_risk))::int, 0) + (spatial < 0.8)::int as conflict_count from field_""",
    "records": "select *, conflict_count > 0 as has_conflicts, 'SOURCE_A' as geometry_source from count_",
    "classes": f"select *, {_LU[0]} as lu_a, {_LU[1]} as lu_b, {_MU[0]} as mu_a, {_MU[1]} as mu_b, {_RI[0]} as ri_a, {_RI[1]} as ri_b from records",
    "found_": f"""
      select record_id, a_id, 'AREA_DISCREPANCY' as conflict_type, 'GEOMETRY' as category, 'area' as field_name, case when area_pct > 15 then 'CRITICAL' when area_pct >= 5 then 'HIGH' else 'MEDIUM' end as severity from classes where area_pct >= 2
      union all select record_id, a_id, 'LAND_USE_CONFLICT', 'SEMANTIC', 'land_use', case when {_PAIRS_OUT} then 'CRITICAL' when (lu_a, lu_b) in (('RESIDENTIAL', 'COMMERCIAL'), ('COMMERCIAL', 'RESIDENTIAL')) then 'HIGH' else 'MEDIUM' end from classes where lu_a <> lu_b
      union all select record_id, a_id, 'MUTATION_CONFLICT', 'REGISTRY', 'mutation_status', case when mu_a in ('DISPUTED', 'REJECTED') or mu_b in ('DISPUTED', 'REJECTED') then 'CRITICAL' when 'APPROVED' in (mu_a, mu_b) and 'PENDING' in (mu_a, mu_b) then 'HIGH' else 'MEDIUM' end from classes where mu_a <> mu_b
      union all select record_id, a_id, 'RISK_CONFLICT', 'RISK', 'risk_level', case when (ri_a in ('CRITICAL', 'HIGH') or ri_b in ('CRITICAL', 'HIGH')) and 'LOW' in (ri_a, ri_b) then 'CRITICAL' when 'HIGH' in (ri_a, ri_b) and 'MEDIUM' in (ri_a, ri_b) then 'HIGH' else 'MEDIUM' end from classes where ri_a <> ri_b
      union all select record_id, a_id, 'GEOMETRY_MISMATCH', 'GEOMETRY', 'geometry', case when spatial < 0.5 or centroid_m > 25 then 'CRITICAL' when spatial < 0.7 or centroid_m > 10 then 'HIGH' when spatial < 0.85 or centroid_m > 5 then 'MEDIUM' else 'LOW' end from classes where spatial < 0.85 or centroid_m > 5 or geometry_status <> 'CONGRUENT'
      union all select record_id, a_id, 'ATTRIBUTE_MISMATCH', 'REGISTRY', 'survey_number', 'MEDIUM' from classes where lower(source_survey) <> lower(candidate_survey)""",
    "conflicts": "select *, 'p1:' || record_id || ':' || conflict_type || ':' || field_name as idempotency_key, 'OPEN' as status from found_",
    "per_record": "select record_id, count(*) as unresolved, count(*) filter (where severity = 'CRITICAL') as critical, count(*) filter (where severity = 'HIGH') as high from conflicts group by 1",
    "check_": f"""select c.*, coalesce(unresolved, 0) as unresolved, coalesce(critical, 0) as critical, coalesce(high, 0) as high,
      case when (spatial <= 0 and centroid_m > 50) or spatial * 100 < 10 then 'FAIL' when spatial * 100 < 50 or centroid_m > 15 then 'WARNING' else 'PASS' end as topology,
      case when source_area is null or candidate_area is null or area_pct > 15 then 'FAIL' when area_pct > 5 then 'WARNING' else 'PASS' end as area_check,
      coalesce({_class('mutation', text.MUTATION)} in ('DISPUTED', 'REJECTED'), false) as disputed, coalesce({_class('risk', text.RISK)} = 'CRITICAL', false) as hazard,
      coalesce((lu_a = 'AGRICULTURAL' or lu_b = 'AGRICULTURAL') and (lu_a in ('INDUSTRIAL', 'COMMERCIAL') or lu_b in ('INDUSTRIAL', 'COMMERCIAL')), false) as farmland
      from classes c left join per_record using (record_id)""",
    "state_": "select *, case when disputed or hazard or farmland then 'WARNING' else 'PASS' end as semantic, case when critical > 0 then 'FAIL' when unresolved > 0 then 'WARNING' else 'PASS' end as conflict_check from check_",
    "checked": """select *, case when 'FAIL' in (topology, area_check, semantic, conflict_check) then 'FAIL' when 'WARNING' in (topology, area_check, semantic, conflict_check) then 'WARNING' else 'PASS' end as overall,
      disputed::int + hazard::int + farmland::int + (topology = 'WARNING')::int + (area_check = 'WARNING')::int + (conflict_check = 'WARNING')::int as n_warnings from state_""",
    "conf_": """select *, round(spatial, 4) as s_spatial, round(geometry, 4) as s_geometry, round(attribute, 4) as s_attribute, case overall when 'PASS' then 1.0 when 'WARNING' then 0.9 else 0.8 end::double as s_temporal,
      critical > 0 or overall = 'FAIL' as blocked, role = 'AMBIGUOUS' or coalesce(score_gap < 0.015 and candidate_count > 1, false) as ambiguous from checked""",
    "raw_": "select *, round(round(0.3 * s_spatial, 4) + round(0.3 * s_geometry, 4) + round(0.3 * s_attribute, 4) + round(0.1 * s_temporal, 4), 4)::double as raw from conf_",
    "cap_": "select *, case when blocked then least(raw, 0.78) else raw end::double as capped from raw_",
    "final_": "select *, case when high > 0 and capped > 0.85 then round(capped - 0.05, 4) else capped end::double as confidence from cap_",
    "confident": "select *, case when ambiguous then 'AMBIGUOUS' when confidence >= 0.9 and not blocked then 'HIGH' when confidence >= 0.7 then 'MEDIUM' else 'LOW' end as bucket from final_",
    "decided": f"select record_id, action, decided_at, chosen_area from ({fx.DECISIONS}) d join records r on r.a_id = d.parcel",
    "worst": f"select record_id, min({_SEVERITY}) as worst, list(distinct conflict_type) as conflict_types from conflicts group by 1",
    "queue": """select c.*, action, decided_at, conflict_types, coalesce(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'][worst], 'NONE') as severity, action is not null as resolved, bucket <> 'HIGH' or critical > 0 or overall = 'FAIL' as mandatory
      from confident c left join decided using (record_id) left join worst using (record_id)""",
    "unify_": """select c.* exclude (land_use, mutation, risk, geometry_source, status), c.land_use as h_lu, c.mutation as h_mu, c.risk as h_ri, action, decided_at, chosen_area from confident c left join decided using (record_id)""",
    "unified_": """select record_id, a_id, b_id, coalesce(action, 'AUTO_CONFIRMED') as decision, case when action = 'REJECT_UNRESOLVED' then 'REJECTED' else 'UNIFIED' end as resolution_status,
      case action when 'REJECT_UNRESOLVED' then 'REJECTED' when 'ACCEPT_SOURCE_B' then 'SOURCE_B' else 'SOURCE_A' end as geometry_source,
      case action when 'REJECT_UNRESOLVED' then null when 'ACCEPT_SOURCE_A' then coalesce(source_land_use, h_lu) when 'ACCEPT_SOURCE_B' then coalesce(candidate_land_use, h_lu) else h_lu end as land_use,
      case action when 'REJECT_UNRESOLVED' then null when 'ACCEPT_SOURCE_A' then coalesce(source_mutation, h_mu) when 'ACCEPT_SOURCE_B' then coalesce(candidate_mutation, h_mu) else h_mu end as mutation,
      case action when 'REJECT_UNRESOLVED' then 'CRITICAL' when 'ACCEPT_SOURCE_A' then coalesce(source_risk, h_ri) when 'ACCEPT_SOURCE_B' then coalesce(candidate_risk, h_ri) else h_ri end as risk,
      case action when 'REJECT_UNRESOLVED' then null when 'ACCEPT_SOURCE_B' then coalesce(candidate_area, harmonized_area) when 'MERGE_RECONCILE' then coalesce(chosen_area, harmonized_area) else harmonized_area end as area,
      confidence, bucket, overall as validation, decided_at, conflict_count from unify_""",
    "unified": "select *, case when resolution_status = 'REJECTED' then 'CONFLICT' when area is not null then 'ACTIVE' else 'INCOMPLETE' end as status from unified_",
    "lineage": """select *, case when decided_at is null then 'HUMAN_REVIEW' else '' end as missing, round(case when decided_at is null then 8 else 9 end / 9.0 * 100, 1)::double as completeness_pct,
      case when resolution_status = 'REJECTED' then 'QUARANTINED' when decided_at is not null then 'COMPLETE' else 'PARTIAL' end as lineage_status from unified""",
    "edges_": "select a_id * 2 as u, b_id * 2 + 1 as v from ranked where status in ('matched', 'possible_match')",
    "both_": "select u, v from edges_ union select v, u from edges_",
    "reach_": "select u, v from both_ union select r.u, b.v from reach_ r join both_ b on r.v = b.u",
    "comp_": "select u as node, least(u, min(v)) as component from reach_ group by u",
    "stored_": "select idempotency_key, 'LOW' as severity, case length(idempotency_key) % 5 when 0 then 'RESOLVED' when 1 then 'IN_REVIEW' else 'OPEN' end as status from conflicts where length(idempotency_key) % 3 <> 0 union all select 'gone', 'HIGH', 'OPEN'",
    "merged_": """select coalesce(o.idempotency_key, n.idempotency_key) as idempotency_key, coalesce(n.severity, o.severity) as severity,
      case when o.idempotency_key is not null and (o.status in ('ACKNOWLEDGED', 'RESOLVED', 'DISMISSED') or n.idempotency_key is null) then o.status else 'OPEN' end as status,
      case when o.idempotency_key is null then 'created' when n.idempotency_key is not null then 'updated' else 'stale' end as change from stored_ o full join conflicts n using (idempotency_key)""",
    "point_near": f"select a_id, b_id, case when {_TOUCH} then 0.0 else {_hav(*_CX)} end as m from parcels join points on a_x1 - 0.004 <= b_x2 and a_x2 + 0.004 >= b_x1 and a_y1 - 0.004 <= b_y2 and a_y2 + 0.004 >= b_y1",
    "nearest_": "select a_id, min(struct_pack(metres := round(m, 2), b := b_id)) as p from point_near where m <= 200 group by a_id",
    "nearest": "select a_id, p.b as b_id, p.metres as metres from nearest_",
    "own_": "select key, max(r) as r from (select id as key, struct_pack(x1 := x1, y1 := y1, x2 := x2, y2 := y2, owner := owner, kind := kind) as r from v1) group by 1",
    "new_": "select key, max(r) as r from (select id as key, struct_pack(x1 := x1, y1 := y1, x2 := x2, y2 := y2, owner := owner, kind := kind) as r from v2) group by 1",
    "diff_": f"""select coalesce(o.key, n.key) as id, o.r as o, n.r as n,
      round({_SERIES("(n.r.x2 - n.r.x1) * (n.r.y2 - n.r.y1)", "(n.r.y1 + n.r.y2) / 2")} - {_SERIES("(o.r.x2 - o.r.x1) * (o.r.y2 - o.r.y1)", "(o.r.y1 + o.r.y2) / 2")}, 2) as area_delta,
      round({_hav("(o.r.x1 + o.r.x2) / 2", "(o.r.y1 + o.r.y2) / 2", "(n.r.x1 + n.r.x2) / 2", "(n.r.y1 + n.r.y2) / 2")}, 2) as shift_m,
      concat_ws(',', case when o.r.owner is distinct from n.r.owner then 'owner' end, case when o.r.kind is distinct from n.r.kind then 'kind' end) as fields from own_ o full join new_ n using (key)""",
    "multi_": """select record_id, attribute, count(*) as sources, count(v) as filled, count(x) as numbers, count(distinct lower(v)) as different, min(x) as low, max(x) as high
      from (select *, try_cast(v as double) as x from (select *, case when lower(trim(value)) not in ('', 'none', 'null', 'unknown', '—', '-') then trim(value) end as v from vals)) group by 1, 2""",
}


def _uses(body: str) -> list[str]:
    return [n for n in CTE if re.search(rf"\b(from|join)\s+{n}\b", body)]


def sql(final: str) -> str:
    """``final`` with the tables above that it needs, in order."""
    need, todo = set(), _uses(final)
    while todo:
        n = todo.pop()
        if n not in need:
            need.add(n)
            todo += _uses(CTE[n])
    names = [n for n in CTE if n in need]
    recursive = "recursive " if "reach_" in need else ""
    return (f"with {recursive}" + ",\n".join(f"{n} as ({CTE[n]})" for n in names) + "\n" if names else "") + final


#: Fixed values of questions, stated here once more so that a wrong one is not wrong on both sides.
_SPATIAL_WORDS = ("within", "near", "proximity", "200m", "100m", "distance", "radius")
_DISPUTE_WORDS = ("conflict", "unresolved", "sources disagree", "what sources", "discrepancies")
_HOTSPOT_WORDS = ("where are unresolved conflicts concentrated", "where are conflicts concentrated", "conflict concentration", "conflict density", "high-conflict areas", "conflict hotspots", "conflicts concentrated")
_COMPARE_WORDS = ("compare the cadastral and drone", "compare cadastral and drone", "compare datasets", "dataset comparison", "cadastral vs drone", "overlap difference", "cadastral and drone datasets")
_ANALYSIS_WORDS = ("overlap drone structures", "parcels overlap", "which cadastral parcels overlap", "find parcels within", "within 100 meters", "municipal assets", "buffer analysis", "find intersections", "containment analysis")
_INVESTIGATE_WORDS = ("final value determined", "complete investigation", "detailed report", "lineage and conflict", "discrepancies and provenance", "multi-step", "full report", "comprehensive analysis")
_FINAL_WORDS = ("final value", "how was it determined", "lineage", "timeline and conflict")
_CONFLICT_WORDS = ("conflict", "discrepancy", "mismatch", "incompatible", "why is this flagged", "why was it resolved", "attribute conflict", "unresolved")
_NEAR_WORDS = ("near", "nearby", "proximity", "distance", "within", "radius", "meters", "around", "coords", "lat", "lon")
_TRACE_WORDS = ("provenance", "history", "timeline", "audit", "lineage", "who accepted", "who reviewed", "trace", "trail")
_CONCEPT_WORDS = ("semantic", "rag", "concept", "meaning", "related documents", "knowledge base")
_ATTRIBUTE_WORDS = ("find", "search", "residential", "commercial", "agricultural", "zoning", "land use", "owner", "address", "show all")
_OVERVIEW_WORDS = ("overview", "summary", "how many", "status", "what is this project", "project summary", "dataset count", "progress")
_COORDINATES = r"[-+]?\d+\.\d+[\s,]+[-+]?\d+\.\d+"
_IDENTIFIER = r"\b(ulr|cad|drn)[-_][a-z0-9]+\b"


def _intent() -> str:
    q = "lower(text)"
    any_ = lambda ws: "(" + " or ".join(f"contains({q}, '{w}')" for w in ws) + ")"
    rules = [
        (f"{any_(_SPATIAL_WORDS)} and {any_(_DISPUTE_WORDS)}", "COMPLEX_SPATIAL_INVESTIGATION"),
        (any_(_HOTSPOT_WORDS), "SPATIAL_CONFLICT_ANALYSIS"),
        (f"{any_(_COMPARE_WORDS)} or ({any_(('compare',))} and {any_(('dataset',))})", "DATASET_COMPARISON"),
        (any_(_ANALYSIS_WORDS), "SPATIAL_ANALYSIS"),
        (f"{any_(_INVESTIGATE_WORDS)} or ({any_(('why is', 'how was'))} and {any_(_FINAL_WORDS)})", "COMPLEX_INVESTIGATION"),
        (any_(_CONFLICT_WORDS), "CONFLICT_EXPLANATION"),
        (f"{any_(_NEAR_WORDS)} or regexp_matches({q}, '{_COORDINATES}')", "SPATIAL_PROXIMITY"),
        (any_(_TRACE_WORDS), "PROVENANCE_TRACE"),
        (any_(_CONCEPT_WORDS), "SEMANTIC_SEARCH"),
        (f"regexp_matches({q}, '{_IDENTIFIER}')", "RECORD_INVESTIGATION"),
        (any_(_ATTRIBUTE_WORDS), "ATTRIBUTE_SEARCH"),
        (any_(_OVERVIEW_WORDS), "PROJECT_OVERVIEW"),
    ]
    return "case " + " ".join(f"when {t} then '{n}'" for t, n in rules) + " else 'GENERAL_GIS_QUERY' end"


_KIND = "case when contains(lower(source), 'cadastral') or contains(lower(source), 'registry') then 'cadastral' when contains(lower(source), 'drone') or contains(lower(source), 'uav') or contains(lower(source), 'ortho') then 'drone' when contains(lower(source), 'municipal') or contains(lower(source), 'asset') then 'infrastructure' else 'other' end"
_WEIGHT = "case " + " ".join(f"when attribute = '{a}' and kind = '{k}' then {w}" for a, by in AUTHORITY.items() for k, w in by.items()) + " else 0.5 end::double"
_STAGES = ", ".join(f"({k + 1}, '{s}')" for k, s in enumerate(STAGES))
_SIM = """(case when {x} is null or {y} is null then null when try_cast({x} as double) is not null and try_cast({y} as double) is not null then 1 - abs(try_cast({x} as double) - try_cast({y} as double)) / greatest(abs(try_cast({x} as double)), abs(try_cast({y} as double)))
  when lower(trim({x})) = lower(trim({y})) then 1.0 when contains(trim({x}), ' ') or contains(trim({y}), ' ')
  then len(list_intersect(regexp_extract_all(lower({x}), '\\w+'), regexp_extract_all(lower({y}), '\\w+'))) / len(list_distinct(list_concat(regexp_extract_all(lower({x}), '\\w+'), regexp_extract_all(lower({y}), '\\w+')))) else 0.0 end)"""
_sim = lambda x, y: _SIM.replace("{x}", x).replace("{y}", y)

FINAL = {
    "candidate_pairs_within": "select a_id, b_id, round(distance, 4) as distance, overlap_pct, is_intersecting, is_containing, relationship from pairs",
    "candidate_counters": "select count(*) as pairs, count(distinct a_id) as sources, count(*) filter (where relationship = 'CONTAINMENT') as containment, count(*) filter (where relationship = 'OVERLAP') as overlap, count(*) filter (where relationship = 'PROXIMITY') as proximity from pairs",
    "centroid_candidates": f"select a_id, b_id, round({_CENTRE}, 3) as centroid_m from near_ where a_x1 - 0.0005 <= b_x2 and a_x2 + 0.0005 >= b_x1 and a_y1 - 0.0005 <= b_y2 and a_y2 + 0.0005 >= b_y1 and ({_CENTRE} <= 50 or {_TOUCH})",
    "match_signals": "select a_id, b_id, round(spatial, 4) as spatial, round(area, 4) as area, round(centroid, 4) as centroid, round(geometry, 4) as geometry, round(attribute, 4) as attribute from signals",
    "match_scored": "select a_id, b_id, score, status from scored",
    "match_ranked": "select a_id, b_id, score, status, rank, candidate_count, score_gap, role, is_best from ranked",
    "match_quality": """select count(*) as total_source_features, count(n) as features_with_candidates, count(*) - count(n) as features_with_no_candidates, count(*) filter (where n = 1) as features_with_one_candidate, count(*) filter (where n > 1) as features_with_multiple_candidates,
      count(*) filter (where role = 'BEST') as features_with_unambiguous_best, count(*) filter (where role = 'AMBIGUOUS') as features_with_ambiguous_best, count(*) filter (where role = 'CONFLICT') as features_with_conflict
      from parcels left join (select a_id, candidate_count as n, role from ranked where rank = 1) using (a_id)""",
    "attribute_similarity": f"""select a_id, b_id, round(coalesce(list_avg(list_filter([{_sim("a_land_use", "b_land_use")}, {_sim("cast(a_area as varchar)", "cast(b_area as varchar)")}, {_sim("a_parcel", "b_structure")}], lambda x: x is not null)), 0.5), 4) as similarity from pairs""",
    "review_queue_top": "select a_id, b_id, score, status, role from ranked where role = 'AMBIGUOUS' or status in ('conflict', 'possible_match') order by case when role = 'AMBIGUOUS' then 1 when status = 'conflict' then 2 when status = 'possible_match' then 3 else 4 end, score desc, a_id, b_id limit 100",
    "review_category_counts": """select count(*) as total, count(*) filter (where status = 'matched') as matched, count(*) filter (where status = 'possible_match') as possible, count(*) filter (where status = 'conflict') as conflict, count(*) filter (where status = 'unmatched') as unmatched,
      count(*) filter (where role = 'AMBIGUOUS') as ambiguous, count(*) filter (where is_best) as best, count(*) filter (where role = 'SECONDARY') as secondary, count(*) filter (where status in ('possible_match', 'conflict')) as review_required from ranked""",
    "match_list_page": "select a_id, b_id, score, rank from ranked where status = 'matched' and score between 0.5 and 1 order by score desc, rank, a_id, b_id limit 50 offset 20",
    "best_match_harmonized": "select record_id, geometry_source, geometry_status, source_area, candidate_area, harmonized_area, area_pct, land_use, mutation, risk, conflict_count, has_conflicts from records",
    "conflict_rules": "select record_id, conflict_type, category, field_name, severity, idempotency_key from conflicts",
    "conflict_counts": "select coalesce(severity, '-') as severity, coalesce(conflict_type, '-') as conflict_type, count(*) as n, count(distinct record_id) as records from conflicts group by grouping sets ((severity), (conflict_type), ())",
    "conflict_list_page": f"select record_id, conflict_type, severity from conflicts where category = 'REGISTRY' and record_id ilike '%1%' order by {_SEVERITY}, record_id, conflict_type limit 50",
    "land_use_normalize": f"select p_partkey, {_class('p_type', text.LAND_USE)} as land_use, {_class('p_type', text.MUTATION)} as mutation, {_class('p_name', text.RISK)} as risk, trim(lower(p_name)) as name from part",
    "validation_results": "select record_id, overall, topology, area_check, semantic, conflict_check, n_warnings from checked",
    "validation_summary": """select count(*) as total, count(*) filter (where overall = 'PASS') as passed, count(*) filter (where overall = 'WARNING') as warned, count(*) filter (where overall = 'FAIL') as failed, 0 as geometry_failed, count(*) filter (where topology = 'FAIL') as topology_failed,
      count(*) filter (where area_check = 'FAIL') as area_failed, count(*) filter (where semantic = 'FAIL') as semantic_failed, count(*) filter (where conflict_check = 'FAIL') as conflict_failed from checked""",
    "validation_list_page": "select record_id, overall, area_check from checked where area_check in ('WARNING', 'FAIL') order by case overall when 'FAIL' then 1 when 'WARNING' then 2 else 3 end, record_id limit 50",
    "confidence_scores": "select record_id, s_spatial, s_geometry, s_attribute, s_temporal, confidence, bucket, case when bucket in ('AMBIGUOUS', 'LOW') then 'FLAGGED' when bucket = 'HIGH' then 'ACCEPTED' when blocked then 'FLAGGED' else 'PENDING' end as review_status from confident",
    "confidence_summary": "select count(*) as total, count(*) filter (where bucket = 'HIGH') as high, count(*) filter (where bucket = 'MEDIUM') as medium, count(*) filter (where bucket = 'LOW') as low, count(*) filter (where bucket = 'AMBIGUOUS') as ambiguous, round(avg(confidence), 4) as average from confident",
    "confidence_list_page": "select record_id, confidence, case when blocked then 'FLAGGED' else 'PENDING' end as review_status from confident where bucket = 'MEDIUM' and contains(record_id, '2') order by confidence desc, record_id limit 50",
    "adjudication_queue": "select record_id, severity, resolved, mandatory, confidence from queue",
    "adjudication_list_page": "select record_id, severity, confidence from queue where severity = 'CRITICAL' and list_contains(conflict_types, 'RISK_CONFLICT') order by resolved, confidence, record_id limit 50",
    "review_summary": """select *, case when mandatory > 0 then round((mandatory - pending) * 100 / mandatory, 1) else 100.0 end as progress_pct, case when pending = 0 then 'completed' when resolved > 0 then 'in_progress' else 'pending' end as stage_status from (
      select count(*) as total, count(*) filter (where mandatory) as mandatory, count(*) filter (where resolved) as resolved, count(*) filter (where mandatory and not resolved) as pending,
      count(*) filter (where action = 'ACCEPT_SOURCE_A') as accept_source_a, count(*) filter (where action = 'ACCEPT_SOURCE_B') as accept_source_b, count(*) filter (where action = 'MERGE_RECONCILE') as merge_reconcile, count(*) filter (where action = 'REJECT_UNRESOLVED') as reject_unresolved,
      count(*) filter (where bucket = 'AMBIGUOUS') as ambiguous, count(*) filter (where severity = 'CRITICAL') as critical, max(decided_at) as last_decision from queue)""",
    "unified_records": "select record_id, decision, resolution_status, geometry_source, land_use, mutation, risk, area, status from unified",
    "unified_stats": """select count(*) as considered, count(*) filter (where resolution_status = 'UNIFIED') as unified, count(*) filter (where resolution_status <> 'UNIFIED') as rejected, count(*) filter (where status = 'ACTIVE') as active, count(*) filter (where decision = 'AUTO_CONFIRMED') as auto_confirmed,
      round(avg(confidence) filter (where resolution_status = 'UNIFIED'), 4) as average_confidence from unified""",
    "unified_list_page": "select record_id, land_use, area from unified where status = 'ACTIVE' and (land_use ilike '%res%' or record_id ilike '%res%') order by record_id limit 50",
    "unified_identifiers": "select record_id, format('ULR-{:06d}', row_number() over (order by a_id)) as identifier from unified",
    "lineage_completeness": "select record_id, completeness_pct, lineage_status, missing from lineage",
    "lineage_edges": " union all ".join(
        (
            "select record_id, 'dataset_parcels' as source, 'feature_parcels-' || a_id as target, 'NORMALIZED_FROM' as kind from unified",
            "select record_id, 'dataset_structures', 'feature_structures-' || b_id, 'NORMALIZED_FROM' from unified",
            "select record_id, 'feature_parcels-' || a_id, 'match_' || record_id, 'PAIRED_IN' from unified",
            "select record_id, 'feature_structures-' || b_id, 'match_' || record_id, 'PAIRED_IN' from unified",
            "select record_id, 'match_' || record_id, 'harmonization_' || record_id, 'HARMONIZED_INTO' from unified",
            "select record_id, 'harmonization_' || record_id, 'conflict_' || record_id, 'EVALUATED_FOR_CONFLICTS' from unified",
            "select record_id, 'conflict_' || record_id, 'validation_' || record_id, 'VALIDATED_BY' from unified",
            "select record_id, 'validation_' || record_id, 'confidence_' || record_id, 'SCORED_BY' from unified",
            "select record_id, 'confidence_' || record_id, 'review_' || record_id, 'ADJUDICATED_IN' from unified",
            "select record_id, 'review_' || record_id, 'unified_' || record_id, 'SYNTHESIZED_AS' from unified",
            "select record_id, 'unified_' || record_id, 'provenance_' || record_id, 'ANCHORS_LINEAGE' from unified",
        )
    ),
    "lineage_nodes": " union all ".join(
        (
            "select record_id, 'dataset_parcels' as id, 'DATASET' as type, 1 as stage, 'COMPLETED' as status from lineage",
            "select record_id, 'dataset_structures', 'DATASET', 1, 'COMPLETED' from lineage",
            "select record_id, 'feature_parcels-' || a_id, 'FEATURE', 4, 'COMPLETED' from lineage",
            "select record_id, 'feature_structures-' || b_id, 'FEATURE', 4, 'COMPLETED' from lineage",
            "select record_id, 'match_' || record_id, 'MATCH', 6, 'COMPLETED' from lineage",
            "select record_id, 'harmonization_' || record_id, 'HARMONIZATION', 7, 'COMPLETED' from lineage",
            "select record_id, 'conflict_' || record_id, 'CONFLICT', 8, case when decided_at is not null then 'RESOLVED' when conflict_count > 0 then 'OPEN' else 'NONE' end from lineage",
            "select record_id, 'validation_' || record_id, 'VALIDATION', 9, coalesce(validation, 'PASS') from lineage",
            "select record_id, 'confidence_' || record_id, 'CONFIDENCE', 10, bucket from lineage",
            "select record_id, 'review_' || record_id, 'HUMAN_REVIEW', 11, 'ADJUDICATED' from lineage",
            "select record_id, 'unified_' || record_id, 'UNIFIED_RECORD', 12, resolution_status from lineage",
            "select record_id, 'provenance_' || record_id, 'PROVENANCE', 13, lineage_status from lineage",
        )
    ),
    "provenance_list_page": "select count(*) as total, count(*) filter (where lineage_status = 'COMPLETE') as complete, count(*) filter (where lineage_status = 'PARTIAL') as partial, count(*) filter (where lineage_status = 'QUARANTINED') as quarantined, round(avg(completeness_pct), 2) as average_completeness from lineage",
    "export_authoritative": "select record_id, land_use, mutation, risk, area, round(confidence, 4) as confidence, round((a_y1 + a_y2) / 2, 7) as lat, round((a_x1 + a_x2) / 2, 7) as lon from unified join parcels using (a_id) where resolution_status = 'UNIFIED'",
    "export_readiness": "select count(*) as total, count(*) filter (where resolution_status = 'UNIFIED') as authoritative, count(*) filter (where resolution_status = 'REJECTED') as quarantined, count(*) filter (where status = 'INCOMPLETE') as incomplete, round(count(*) filter (where lineage_status in ('COMPLETE', 'PARTIAL')) * 100.0 / count(*), 1) as provenance_pct from lineage",
    "row_sha256": "select c_custkey, sha256(concat(coalesce(c_custkey::varchar, ''), '|', coalesce(c_name, ''), '|', coalesce(c_nationkey::varchar, ''), '|', coalesce(c_mktsegment, ''))) as sha256 from customer",
    "audit_timeline": "select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as item from events",
    "latest_stage_run": "select stage, run_id, status from (select *, row_number() over (partition by stage order by completed_at desc, run_id desc) as k from runs) where k = 1",
    "latest_version": "select user_id, arg_max(event_id, struct_pack(t := ts, e := event_id)) as latest, count(*) as versions from events group by 1",
    "stage_gate": f"""with last as (select * from (select *, row_number() over (partition by stage order by completed_at desc, run_id desc) as k from ({fx.RUNS})) where k = 1),
      s as (select n.stage, n.name, coalesce(l.status, 'pending') as status from (values {_STAGES}) n(stage, name) left join last l using (stage))
      select s.stage, s.name, s.status, b.status is null or b.status = 'completed' as may_run from s left join s b on b.stage = s.stage - 1""",
    "components": "select node, component from comp_",
    "component_members": "select component, count(*) as size, string_agg(node::varchar, ',' order by node) as nodes from comp_ group by 1",
    "merge_idempotent": "select idempotency_key, severity, status, change from merged_",
    "merge_changes": "select change, count(*) as n from merged_ group by 1",
    "merge_events": "select distinct user_id, event_type from events",
    "proximity_nearest_ref": "select a_id, b_id, metres from nearest",
    "knn_assets": f"select a_id, b_id, metres, rank from (select p.b_id as a_id, q.b_id, round({_hav('p.b_x1', 'p.b_y1', 'q.b_x1', 'q.b_y1')}, 2) as metres, row_number() over (partition by p.b_id order by round({_hav('p.b_x1', 'p.b_y1', 'q.b_x1', 'q.b_y1')}, 2), q.b_id) as rank from points p, points q) where rank <= 5",
    "intersection_pairs": f"select a_id, b_id, round({_SERIES(_OVER, '(greatest(a_y1, b_y1) + least(a_y2, b_y2)) / 2')}, 2) as overlap_m2, round({_OVER} / nullif({_AA}, 0) * 100, 2) as overlap_pct from near_ where {_TOUCH} and round({_OVER} / nullif({_AA}, 0) * 100, 2) >= 5",
    "containment_pairs": f"select a_id, b_id from near_ where {_HOLDS}",
    "buffer_hits": "select a_id, b_id from parcels cross join points where sqrt(pow((a_x1 + a_x2) / 2 - b_x1, 2) + pow((a_y1 + a_y2) / 2 - b_y1, 2)) <= 60 / (111320.0 * greatest(0.2, cos(radians((a_y1 + a_y2) / 2))))",
    "dataset_compare": f"select count(*) as pairs, (select count(*) from parcels) - count(distinct a_id) as a_only, (select count(*) from structures) - count(distinct b_id) as b_only from near_ where {_TOUCH}",
    "version_diff": """select id, case when o is null then 'ADDED' when n is null then 'REMOVED' when abs(area_delta) > 0.5 or shift_m > 0.5 or fields <> '' then 'CHANGED' else 'UNCHANGED' end as change, area_delta, case when o is not null and n is not null then shift_m end as shift_m, case when o is not null and n is not null then fields end as changed_fields from diff_""",
    "spatial_statistics": f"""select features, area_m2, round(area_m2 / 10000, 4) as hectares, 100.0::double as valid_pct, min_x, min_y, max_x, max_y from (select count(*) as features, sum(round({_SERIES(_AA, _CX[1])}, 2)::decimal(20, 2))::double as area_m2,
      round(min(a_x1), 6) as min_x, round(min(a_y1), 6) as min_y, round(max(a_x2), 6) as max_x, round(max(a_y2), 6) as max_y from parcels)""",
    "conflict_clusters": """select round(lat, 2) as cell_lat, round(lon, 2) as cell_lon, count(*) as conflicts, count(distinct record_id) as records, string_agg(distinct field_name, ',' order by field_name) as fields, round(avg(lat::decimal(20, 8)), 6) as lat, round(avg(lon::decimal(20, 8)), 6) as lon,
      round(min(lon) - 0.001, 6) as min_lon, round(max(lat) + 0.001, 6) as max_lat from (select c.*, round((a_y1 + a_y2) / 2, 8) as lat, round((a_x1 + a_x2) / 2, 8) as lon from conflicts c join parcels using (a_id)) x group by round(x.lat, 2), round(x.lon, 2)""",
    "near_coordinates": f"select id, metres from (select id, round({_hav('x', 'y', '73.86', '18.522')}, 2) as metres from assets) where metres <= 1500",
    "proximity_stats": "select count(*) as n, min(metres) as least, max(metres) as most, round(avg(metres), 3) as mean from nearest",
    "pair_metrics": f"select a_id, b_id, round({_METRIC(_AA, _CX[1])}, 1) as area_a, round({_SERIES(_BA, _CX[3])}, 1) as area_b, round({_CENTRE}, 3) as offset_m from pairs",
    "crs_web_mercator": "select a_id, round(6378137.0 * radians(a_x1), 3) as x, round(6378137.0 * ln(tan(pi() / 4 + radians(a_y1) / 2)), 3) as y from parcels",
    "dataset_layers": """select 'parcels' as layer, '#2563eb' as colour, round(min(a_x1), 6) as min_x, round(min(a_y1), 6) as min_y, round(max(a_x2), 6) as max_x, round(max(a_y2), 6) as max_y from parcels
      union all select 'assets', '#16a34a', round(min(x), 6), round(min(y), 6), round(max(x), 6), round(max(y), 6) from assets""",
    "profile_attributes": " union all ".join(f"select '{c}' as attribute, '{k}' as kind, count(*) - count({c}) as nulls, count(distinct {c}) as distinct_values from customer" for c, k in (("c_custkey", "Integer"), ("c_name", "String"), ("c_nationkey", "Integer"), ("c_acctbal", "Float"), ("c_mktsegment", "String"))),
    "profile_extent": "select round(min(a_x1), 6) as min_x, round(min(a_y1), 6) as min_y, round(max(a_x2), 6) as max_x, round(max(a_y2), 6) as max_y from parcels",
    "profile_geometry": "select count(*) as total, count(*) filter (where v and not e) as valid, count(*) filter (where e) as empty, count(*) filter (where not v and not e) as invalid, 'Polygon' as dominant, round(count(*) filter (where v and not e) * 100.0 / count(*), 1) as valid_pct from (select p_partkey % 33 <> 0 as v, p_partkey % 50 = 0 as e from part)",
    "attribute_conflicts_multi": """select record_id, attribute, conflict_type, sources, different, case when numeric_ then round(high - low, 2) end as gap from (select *, case when numeric_ and high - low > 1 and (high - low) / greatest(abs(high), abs(low)) > 0.05 then 'NUMERIC_DIFFERENCE' when not numeric_ and different > 1 then 'VALUE_MISMATCH'
      when filled > 0 and filled < sources then 'NULL_VALUE_CONFLICT' end as conflict_type from (select *, numbers >= 2 and numbers = filled as numeric_ from multi_)) where conflict_type is not null""",
    "conflict_advice": f"select record_id, attribute, m.s as source, m.v as value, m.w as weight from (select record_id, attribute, max(struct_pack(w := w, s := source, v := value)) as m from (select *, {_WEIGHT} as w from (select *, {_KIND} as kind from vals where value is not null)) group by 1, 2)",
    "record_sources": "select record_id, string_agg(distinct source, ';' order by source) as sources, string_agg(distinct attribute, ';' order by attribute) as features, count(*) as n from vals group by 1",
    "record_conflict_counts": "select record_id, sum(s::int) as unresolved, sum(r::int) as resolved, sum(x::int) as dismissed, case when sum(s::int) > 0 then 'CONFLICT' else 'ACTIVE' end as state from (select record_id, length(record_id) % 3 = 1 as s, length(record_id) % 3 = 0 as r, length(record_id) % 3 = 2 as x from conflicts) group by 1",
    "record_status_legacy": f"""select record_id, sources, case when open_ or (high - low) / high > 0.3 then 'CONFLICT' when sources < 2 or high is null then 'INCOMPLETE' else 'ACTIVE' end as status from (
      select record_id, count(distinct source) as sources, min(try_cast(value as double)) as low, max(try_cast(value as double)) as high, record_id in (select parcel from ({fx.DECISIONS}) where action = 'REJECT_UNRESOLVED') as open_ from vals where attribute = 'area_sqm' and record_id % 3 <> 0 group by 1)""",
    "attribute_search": "select c_custkey, case when contains(lower(c_name), 'build') then 'c_name' else 'c_mktsegment' end as matched_field from customer where contains(lower(c_name), 'build') or contains(lower(c_mktsegment), 'build')",
    "document_search": "select doc_id, source from documents where text ilike '%license%'",
    "vector_topk": "select vec_id, round(least(1.0, greatest(0.0, (list_dot_product(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)) + 1) / 2)), 4) as similarity from embeddings order by similarity desc, vec_id limit 10",
    "intent_route": f"select conv_id, turn, {_intent()} as intent from conversations",
    "grounding_score": """select answer_id, evidence, cited, round(case when evidence = 0 then 0 when cited > 0 then least(1.0, 0.70 + 0.08 * cited) else 0.85 end, 2)::double as score from (select o_orderkey as answer_id, count(i) as evidence, count(*) filter (where contains(lower('Order of ' || lower(o_orderpriority) || ' status ' || o_orderstatus), lower(i))) as cited
      from orders left join (values ('urgent'), ('high'), ('status f'), ('medium'), ('LOW')) e(i) on o_orderkey % 7 <> 0 group by 1)""",
    "kb_documents": "select 'record' as category, record_id, 'Record ' || record_id as title, format('Record {} is {} with land use {} and area {}.', record_id, status, coalesce(land_use, 'unknown'), coalesce(format('{:.2f}', area), 'unknown')) as content from unified where resolution_status = 'UNIFIED'",
    "project_summary": "select status, resolution_status, count(*) as records, sum(conflict_count) as conflicts from unified group by 1, 2",
}

SQL = {name: sql(final) for name, final in FINAL.items()}
