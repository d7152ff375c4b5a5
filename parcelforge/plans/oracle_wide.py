"""DuckDB SQL of the queries in catalog_wide, with its own constants."""

from __future__ import annotations

from parcelforge.plans import fixtures as fx
from parcelforge.plans import oracle
from parcelforge.plans.oracle_more import _with

_STATUS = "case when (spatial >= 0.5 or centroid >= 0.7) and (attribute < 0.25 or area < 0.35) then 'conflict' when score >= {m} then 'matched' when score >= {p} then 'possible_match' when score >= 0.4 and (spatial >= 0.5 or centroid >= 0.7) then 'conflict' else 'unmatched' end"
_STATE = "case when a_id % 41 = 0 then 'self-intersection' when a_id % 43 = 0 then 'NULL' when a_id % 47 = 0 then 'EMPTY' else 'VALID' end"
_LEFT = "1 - least(1.0, coalesce(area_pct, 0) / 100) * 0.75"
_IN = lambda x, y: f"len(list_filter(string_split(lower(trim({x})), ' '), lambda w: contains(lower(trim({y})), w))) > 0"
_ROLE = "case when source = 'municipal assets' then 'MUNICIPAL' when contains(source, 'cadastr') then 'CADASTRAL' when contains(source, 'drone') then 'DRONE' else 'OTHER' end"
_LON, _LAT = "round((a_x1 + a_x2) / 2, 8)", "round((a_y1 + a_y2) / 2, 8)"

FINAL = {
    "match_filtered_page": "select a_id, b_id, score, rank from ranked where status = 'conflict' and role = 'CONFLICT' and score between 0.4 and 0.75 and b_id % 2 = 0 order by score desc, rank, a_id, b_id limit 40 offset 5",
    "match_table_page": "select a_id, b_id, score_gap from ranked where score >= 0.2 and contains(lower(a_parcel), 'cp-1') order by coalesce(score_gap, 0) desc, a_id, b_id limit 25 offset 25",
    "match_best_page": "select a_id, b_id, score from ranked where is_best order by b_structure, a_id, b_id limit 50",
    "conflict_filtered_page": "select record_id, conflict_type, severity from conflicts where severity = 'HIGH' and (record_id ilike '%1_2%' or field_name ilike '%1_2%') order by a_id desc, record_id, conflict_type limit 60",
    "attribute_conflict_page": "select 'R-' || record_id as identifier, attribute, 'VALUE_MISMATCH' as conflict_type, 'HIGH' as severity from multi_ where attribute = 'owner_name' and not (numbers >= 2 and numbers = filled) and different > 1 order by record_id desc limit 80",
    "validation_filtered_page": "select record_id, overall, topology from checked where topology in ('WARNING', 'FAIL') and record_id like '%7%' order by case overall when 'FAIL' then 1 when 'WARNING' then 2 else 3 end, record_id limit 50",
    "confidence_filtered_page": "select record_id, confidence from confident where (bucket in ('AMBIGUOUS', 'LOW') or bucket = 'MEDIUM' and blocked) and contains(record_id, '4_') order by confidence desc, record_id limit 50",
    "unified_filtered_page": "select record_id, land_use from unified where status = 'ACTIVE' and resolution_status = 'UNIFIED' and (record_id ilike '%p-1%3%' or 'CP-' || a_id ilike '%p-1%3%' or 'DS-' || b_id ilike '%p-1%3%' or land_use ilike '%p-1%3%') order by record_id limit 50",
    "provenance_filtered_page": "select record_id, completeness_pct from lineage where lineage_status = 'PARTIAL' and record_id like '%3%' order by record_id limit 50",
    "provenance_rejected_page": "select record_id, lineage_status from lineage where resolution_status = 'REJECTED' order by record_id limit 50",
    "record_lookup": "select a_id, a_parcel from parcels where a_id in (17, 18)",
    "project_isolation": "select a_id, b_id, relationship from pairs where a_id % 3 = 1 and b_k % 3 = 1",
    "project_deleted": "select 'parcels' as kind, 'p' || a_id % 3 as state, count(*) as n from parcels where a_id % 3 <> 2 group by 2 union all select 'assets', 'p' || id % 3, count(*) from assets where id % 3 <> 2 group by 2",
    "project_overview": f"select 'records' as kind, status as state, count(*) as n from unified group by 2 union all select 'conflicts', severity, count(*) from conflicts group by 2 union all select 'runs', status, count(*) from runs group by 2 union all select 'decisions', action, count(*) from ({fx.DECISIONS}) group by 2",
    "latest_dataset_features": "select event_id, user_id as dataset_id, user_id || ':' || event_type as version_id from events where (user_id, event_type) in (select user_id, max(event_type) from events group by 1)",
    "asset_match_scored": f"""with s as (select a_id, b_id, centroid, case when b_x1 > a_x1 and b_x1 < a_x2 and b_y1 > a_y1 and b_y1 < a_y2 then 1.0::double else centroid end as geometry
      from (select *, greatest(0.0::double, 1 - {oracle._CENTRE} / 50) as centroid from (select *, {oracle._GAP} as distance from parcels join points on a_x1 - 0.001 <= b_x2 and a_x2 + 0.001 >= b_x1 and a_y1 - 0.001 <= b_y2 and a_y2 + 0.001 >= b_y1) where distance <= 50)),
      t as (select *, round((0.20::double * centroid + 0.15::double * geometry + 0.10::double * 0.5) / (0.20::double + 0.15::double + 0.10::double), 4) as score from s)
      select a_id, b_id, null::double as spatial, null::double as area, round(geometry, 4) as geometry, score, case when score >= 0.8 then 'matched' when score >= 0.6 then 'possible_match' when score >= 0.4 and centroid >= 0.7 then 'conflict' else 'unmatched' end as status from t""",
    "match_scored_stage": f"select {_STATUS.format(m=0.75, p=0.55)} as status, count(*) as n from score_ group by 1",
    "match_scored_attributes": f"""with sim as ({oracle.FINAL["attribute_similarity"]}),
      u as (select a_id, b_id, spatial, area, centroid, similarity::double as attribute, round(0.35 * spatial + 0.20 * area + 0.20 * centroid + 0.15 * geometry + 0.10 * similarity, 4)::double as score from (select * replace (spatial::double as spatial, area::double as area, centroid::double as centroid) from signals) join sim using (a_id, b_id))
      select a_id, b_id, attribute, score, {_STATUS.format(m=0.8, p=0.6)} as status from u""",
    "validation_geometry": f"select record_id, case when st = 'VALID' then 'PASS' else 'FAIL' end as geometry_check, case when st <> 'VALID' then 'source geometry: ' || st end as geometry_failure, case when st <> 'VALID' then 'FAIL' else overall end as overall from (select *, {_STATE} as st from checked)",
    "unified_geometry_status": f"select record_id, st = 'VALID' as geometry_valid, case when resolution_status = 'REJECTED' then 'CONFLICT' when st = 'VALID' and area is not null then 'ACTIVE' else 'INCOMPLETE' end as status from (select *, {_STATE} as st from unified)",
    "confidence_cascade": f"""select record_id, round(case when a_id % 3 = 0 then case area_check when 'FAIL' then least({_LEFT}, 0.4) when 'WARNING' then least({_LEFT}, 0.75) else {_LEFT} end else geometry end, 4)::double as s_geometry,
      round(case when a_id % 5 < 2 then case when source_land_use is null or candidate_land_use is null then 0.85 when lower(trim(source_land_use)) = lower(trim(candidate_land_use)) then 1.0 when {_IN("source_land_use", "candidate_land_use")} or {_IN("candidate_land_use", "source_land_use")} then 0.8 else 0.45 end else attribute end, 4)::double as s_attribute from checked""",
    "pair_lookup": "select c.record_id, r.score, r.role, c.confidence from confident c join ranked r using (a_id, b_id)",
    "geometry_kinds": "select case when p_partkey % 10 = 0 then 'Point' else 'Polygon' end as kind, count(*) as features from part group by 1",
    "conflict_clusters_joined": f"select printf('CLUST_%.2f_%.2f', round({_LAT}, 2), round({_LON}, 2)) as cluster_id, count(*) as conflicts, count(distinct record_id) as records from conflicts join parcels using (a_id) group by 1",
    "conflict_source_pairs": f"select round({_LAT}, 2) as cell_lat, round({_LON}, 2) as cell_lon, 'cadastral' as source_a, case when split_part(record_id, '_', 2)::bigint % 2 = 0 then 'drone north' else 'drone south' end as source_b, count(*) as conflicts from conflicts join parcels using (a_id) group by all",
    "assets_in_box": "select id from assets where x between 73.855 and 73.87 and y between 18.52 and 18.53",
    "unified_role_statistics": f"select count(distinct record_id) as records, round(count(*) / count(distinct record_id), 2) as average_sources, count(distinct record_id) filter (where role = 'CADASTRAL') as with_cadastral, count(distinct record_id) filter (where role = 'DRONE') as with_drone, count(distinct record_id) filter (where role = 'MUNICIPAL') as with_municipal from (select record_id, {_ROLE} as role from vals)",
    "attribute_by_role": f"select record_id, attribute, string_agg(role || '=' || value, ';' order by role) as values from (select record_id, attribute, {_ROLE} as role, max(value) as value from vals where value is not null group by all) group by 1, 2",
    "sources_in_order": "select user_id, string_agg(event_type, ',' order by o) as kinds from (select user_id, event_type, min(event_id) as o from events group by 1, 2) group by 1",
    "record_trail": "select record_id, coalesce(action, 'AUTO_CONFIRMED') as decision, resolved::varchar as adjudicated, unresolved::varchar as conflicts, overall as validation, role from queue",
    "components_assigned": "with x as (select component, min('R' || node // 20) as record, count(distinct 'R' || node // 20) - 1 as merged from comp_ where node % 10 = 0 group by 1) select c.component, x.record, coalesce(x.merged, 0) as merged from (select distinct component from comp_) c left join x using (component)",
    "evidence_bundles": "select u.record_id, u.status, u.decision as action, e.evidence from unified u left join (select record_id, string_agg(conflict_type || ':' || severity, ',' order by conflict_type, severity) as evidence from conflicts group by 1) e using (record_id)",
    "date_slugs": "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as iso, strftime(ts, '%Y%m%d_%H%M%S') as slug from events",
    "version_map_diff": "select id, concat_ws(',', case when o.owner <> n.owner then 'owner:' || o.owner || '>' || n.owner end, case when o.kind <> n.kind then 'kind:' || o.kind || '>' || n.kind end) as changed from v1 o join v2 n using (id)",
    "export_features": """select record_id, '{"type":"Feature","geometry":null,"properties":' || json_object('record_id', record_id, 'land_use', land_use, 'status', status, 'decision', decision)::varchar || '}' as feature from unified where resolution_status = 'UNIFIED'""",
    "short_ids": "select c_custkey, substr(coalesce(c_name, c_custkey::varchar), 1, 8) as short from customer",
    "kb_all_documents": """select 'project' as category, 'p1' as entity_id, 'Project Wards' as title, concat_ws(chr(10), 'Project: Wards', 'Datasets: parcels, structures', 'Records: 2', 'Conflicts: 0') as content
      union all select 'dataset', n_nationkey::varchar, 'Dataset ' || n_name, concat_ws(chr(10), 'Dataset: ' || n_name, 'Format: csv', 'Geometry: unknown', 'Features: ' || n_regionkey) from nation
      union all select 'conflict', record_id || ':' || field_name, 'Conflict on ' || field_name, concat_ws(chr(10), 'Conflict: ' || conflict_type, 'Record: ' || record_id, 'Field: ' || field_name, 'Severity: ' || severity, 'Status: ' || status) from conflicts
      union all select 'provenance', user_id::varchar, 'Provenance of ' || user_id, string_agg(k || '. ' || event_type, chr(10) order by k) from (select *, row_number() over (partition by user_id order by ts, event_id, event_type) as k from events) group by user_id""",
    "csv_points_parse": "select id::varchar as feature_id, name, id % 7 = 0 as missing from assets",
    "kb_search": "select vec_id, round(least(1.0, greatest(0.0, (list_dot_product(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)) + 1) / 2)), 4) as similarity from embeddings where vec_id % 3 = 1 order by similarity desc, vec_id limit 10",
}

SQL = {name: _with(final) for name, final in FINAL.items()}
