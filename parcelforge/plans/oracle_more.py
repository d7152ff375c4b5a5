"""DuckDB SQL of the further queries."""

from __future__ import annotations

from parcelforge.plans import oracle
from parcelforge.plans.oracle import sql

_KEYS = "json_keys(props)"
_ROLE = "case when contains(lower(source), 'cadastr') or contains(lower(source), 'parcel') then 'CADASTRAL' when contains(lower(source), 'drone') or contains(lower(source), 'structure') or contains(lower(source), 'building') then 'DRONE' when contains(lower(source), 'muni') or contains(lower(source), 'mun_') or contains(lower(source), 'tax') then 'MUNICIPAL' else 'OTHER' end"
_SAY = lambda label, c: f"case when {c} >= 0.7 then 'strong {label} ' || round({c} * 100, 0)::int || '%' when {c} < 0.25 then 'weak {label}' end"
_STATE = "case length(record_id) % 3 when 0 then 'RESOLVED' when 1 then 'OPEN' else 'DISMISSED' end"

FINAL = {
    "polygon_overlap": f"select a_id, b_id, round({oracle._IOU}, 4) as iou from pairs where {oracle._TOUCH}",
    "latest_review": "select user_id, arg_max(event_type, struct_pack(t := ts, e := event_id)) as decision, count(*) as reviews from events group by 1",
    "match_resolution_cascade": """with r as (select p_partkey as record_id, case when p_partkey % 3 = 0 then p_partkey end as t, case when p_partkey % 5 = 0 then p_partkey + 7 end as c from part), m as (select p_partkey * 2 as id from part)
      select record_id, coalesce(a.id, b.id, p.id) as match_id, case when a.id is not null then 'trail' when b.id is not null then 'decision' when p.id is not null then 'pair' end as found_by from r left join m a on a.id = t left join m b on b.id = c left join m p on p.id = record_id""",
    "record_geometry_winner": f"select record_id, m.r as role, m.f as feature_id from (select record_id, min(struct_pack(o := o, f := attribute, r := role)) as m from (select *, list_position(['CADASTRAL', 'DRONE', 'MUNICIPAL', 'OTHER'], role) as o from (select *, {_ROLE} as role from vals)) group by 1)",
    "record_status_transition": f"select record_id, case when bool_or(o) then 'CONFLICT' else 'ACTIVE' end as record_status, count(*) filter (where o) as material from (select record_id, {_STATE} = 'OPEN' and severity <> 'LOW' as o from conflicts) group by 1",
    "decision_cascade": "select case when action = 'REJECT_UNRESOLVED' then 'DISMISSED' when action is not null then 'RESOLVED' else 'OPEN' end as status, conflict_type, count(*) as n from conflicts left join decided using (record_id) group by 1, 2",
    "demo_review_seed": "select a_id, b_id, decision from (select *, case when is_best then 'ACCEPTED' when role = 'AMBIGUOUS' then 'FLAGGED' when status = 'conflict' then 'REJECTED' end as decision from ranked where rank = 1 and a_id % 4 <> 0) where decision is not null",
    "merge_attribute_conflicts": """select key, conflict_type, case when length(key) % 4 = 0 then 'RESOLVED' else 'UNRESOLVED' end as status, case when length(key) % 2 = 0 then 'updated' else 'created' end as change from (
      select record_id || ':' || attribute as key, case when numeric_ and high - low > 1 and (high - low) / greatest(abs(high), abs(low)) > 0.05 then 'NUMERIC_DIFFERENCE' when not numeric_ and different > 1 then 'VALUE_MISMATCH' when filled > 0 and filled < sources then 'NULL_VALUE_CONFLICT' end as conflict_type
      from (select *, numbers >= 2 and numbers = filled as numeric_ from multi_)) where conflict_type is not null""",
    "merge_validation": "select 'p1:' || record_id as key, overall as status from checked",
    "suggested_questions": """with n as (select count(*) as total, coalesce(sum(conflict_count), 0) as open, count(*) filter (where status = 'CONFLICT') as c, count(*) filter (where status = 'INCOMPLETE') as i, count(*) filter (where decision = 'AUTO_CONFIRMED') as u from unified) select (row_number() over (order by k) - 1)::int as place, question from (
      select 1 as k, 'Provide an executive overview of this project and harmonization status.' as question union all select 2, 'Find parcels within 100 meters of municipal assets.' union all select 3, 'Which cadastral parcels overlap drone structures?'
      union all select 4, 'Where are unresolved conflicts concentrated?' union all select 5, 'Compare the cadastral and drone datasets.' union all select 6, 'What changed between dataset versions?'
      union all select 7, 'Find parcels within 200m of municipal assets with conflicts and suggest what should be reviewed.' from n where open > 0
      union all select 8, case when total > 0 then 'Find all parcels with commercial or residential land use.' else 'What datasets have been ingested and what are their spatial coordinate reference systems?' end from n
      union all select 9, 'Why are ' || c || ' records in conflict?' from n where c > 0 union all select 10, 'Which records are incomplete?' from n where i > 0
      union all select 11, 'Which of the ' || u || ' confirmed records were not reviewed?' from n where u > 0 union all select 12, 'Give me an overview of the project.' from n where total > 0)""",
    "record_questions": """select record_id, 0 as place, 'What datasets and source features contributed to record ' || record_id || '?' as question from unified union all select record_id, 1, 'What is the complete provenance and audit trail for ' || record_id || '?' from unified
      union all select record_id, 2, case when status = 'CONFLICT' or conflict_count > 0 then 'Why is ' || record_id || ' flagged with attribute conflicts and suggest how it should be resolved?' else 'Find other unified records within 100 meters of ' || record_id || '.' end from unified""",
    "answer_grounding": """with cited as (select o_orderkey, 1 as p, o_orderkey::varchar as i from orders where o_orderkey % 7 <> 0 and length(o_orderkey::varchar) > 0
        union all select o_orderkey, 2, 'X' || o_custkey || ':URGENT' from orders where o_orderkey % 7 <> 0 and contains(lower(o_orderpriority), 'urgent')
        union all select o_orderkey, 3, 'status-' || o_orderstatus from orders where o_orderkey % 7 <> 0 union all select o_orderkey, 4, 'none' from orders where o_orderkey % 7 <> 0)
      select o.o_orderkey as answer_id, round(case when o.o_orderkey % 7 = 0 then 0 else least(1.0, 0.70 + 0.08 * count(p)) end, 2)::double as score, count(p)::int as n, coalesce(string_agg(i, ';' order by p), '') as cited from orders o left join cited c on c.o_orderkey = o.o_orderkey group by 1""",
    "property_normalize": f"select event_id, array_to_string(list_sort(list_transform({_KEYS}, lambda k: lower(k))), ',') as keys, coalesce(nullif(trim(props::json ->> 'missing'), ''), nullif(trim(props::json ->> 'k'), ''), nullif(trim(props::json ->> 'a'), ''), nullif(trim(props::json ->> 'id'), ''), nullif(trim(props::json ->> 'page'), ''), nullif(trim(props::json ->> 'ref'), '')) as first_value, len({_KEYS}) as n from events",
    "explanation_text": f"select a_id, b_id, concat_ws('; ', {_SAY('overlap', 'spatial')}, {_SAY('area', 'area')}, {_SAY('position', 'centroid')}, {_SAY('attributes', 'attribute')}) as reasons, case status when 'matched' then 'HIGH' when 'unmatched' then 'UNMATCHED' else 'REVIEW_REQUIRED' end as category from scored",
    "combined_layers": "select 'parcels' as layer, a_id as id, round(a_x1, 6) as x, round(a_y1, 6) as y from parcels union all select 'assets', id, round(x, 6), round(y, 6) from assets",
    "attribute_key_diff": f"select event_id, array_to_string(list_sort(list_filter({_KEYS}, lambda k: k not in ('page', 'ref', 'k'))), ',') as added, array_to_string(list_sort(list_filter(['page', 'ref', 'k'], lambda k: not list_contains({_KEYS}, k))), ',') as removed, len(list_distinct(list_concat({_KEYS}, ['page', 'ref', 'k']))) as all_keys from events",
    "candidate_pairs_left_all": "select p.a_id, q.b_id, round(q.distance, 4) as distance, q.relationship from parcels p left join pairs q using (a_id)",
    "unmatched_parcels_all": f"select a_id from parcels where a_id not in (select a_id from near_ where {oracle._TOUCH})",
    "merge_unified_all": "select record_id, 'OLD' as status from records where a_id % 2 = 0 and record_id not in (select record_id from unified) union all select record_id, status from unified",
}

def _with(final: str) -> str:
    """A text that has tables of its own joins the list of those it needs."""
    if not final.startswith("with "):
        return sql(final)
    whole = sql(final)
    return whole if whole == final else whole.replace("\nwith ", ",\n", 1)


SQL = {name: _with(final) for name, final in FINAL.items()}
