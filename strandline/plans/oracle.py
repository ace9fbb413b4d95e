"""The queries of the catalogue in standard SQL, over the same tables."""

from __future__ import annotations

from strandline.config import FILL_VALUES, MODE_COLUMNS, SEARCH_TRIALS, SPARSE_COLUMNS
from strandline.operators.search import FAMILIES, PENALTIES
from strandline.sources.tables import LABEL_LIMIT

KEYS = ["customer_ID", "S_2", "row_id"]
AMOUNTS = ["P_2", "S_3", "B_1", "B_17", "D_39"]
CODES = ["D_117", "D_126", "D_68", "D_120", "B_30", "D_114", "D_116", "B_38", "D_144"]
PANEL_COLUMNS = [*KEYS, *AMOUNTS, "D_42", "B_39", "D_63", "D_64", *CODES]
FLAGS = {"D_63_HIGH": "D_63 = 'HIGH'", "D_63_LOW": "D_63 = 'LOW'", "D_63_MEDIUM": "D_63 = 'MEDIUM'",
         "D_64_-1": "D_64 = '-1'", "D_64_F": "D_64 = 'F'"}
PANEL = """
with lines as (
  select l_orderkey, sum(l_tax) as P_2, sum(l_discount) as S_3, sum(l_quantity) as B_1,
    min(l_extendedprice) as B_17, max(l_quantity) as most_of_a_part,
    count(*)::double as D_117, max(l_linenumber)::double as D_126,
    (count(*) filter (l_returnflag = 'R'))::double as D_68,
    ((count(*) filter (l_linestatus = 'O')) > 0)::int::double as D_120,
    ((count(*) filter (l_returnflag = 'A')) > 1)::int::double as B_30,
    ((count(*) filter (l_returnflag = 'N')) > 0)::int::double as D_114,
    ((count(*) filter (l_quantity > 40)) > 0)::int::double as D_116,
    (count(*) filter (l_returnflag = 'N'))::double as B_38,
    (count(*) > 4)::int::double as D_144
  from lineitem group by l_orderkey
), panel as (
  select o_custkey as customer_ID, o_orderdate::date as S_2, o_orderkey as row_id,
    P_2, S_3, B_1, B_17,
    case when o_orderstatus <> 'P' then o_totalprice end as D_39,
    case when o_orderstatus = 'P' and o_orderpriority = '1-URGENT' then o_totalprice end as D_42,
    case when o_orderstatus = 'F' and o_orderpriority = '5-LOW' then most_of_a_part end as B_39,
    nullif(substr(o_orderpriority, 3), 'NOT SPECIFIED') as D_63,
    nullif(o_orderstatus, 'P') as D_64,
    D_117, D_126, D_68, D_120, B_30, D_114, D_116, B_38, D_144
  from orders left join lines on o_orderkey = l_orderkey
)"""


def _filled(column: str) -> str:
    value = FILL_VALUES.get(column)
    if value is None:
        return column
    return f"coalesce({column}, {repr(value)}) as {column}"


def _listed(columns) -> str:
    return ", ".join(columns)


def _flags(source: str = "") -> str:
    return ", ".join(f"coalesce(({cond})::int, 0) as \"{name}\"" for name, cond in FLAGS.items())


def _describe(table: str, columns, extra: str = "", where: str = "") -> str:
    head = f"{extra}, " if extra else ""
    return " union all ".join(
        f"select {head}'{c}' as \"column\", count({c}) as n, round(avg({c}), 6) as mean, "
        f"round(stddev_samp({c}), 6) as stddev, min({c})::double as min, max({c})::double as max "
        f"from {table} {where}" for c in columns)


KEPT = [c for c in PANEL_COLUMNS if c not in SPARSE_COLUMNS]
FILLED = PANEL + f""", filled as (select {_listed(_filled(c) for c in KEPT)} from panel),
cleaned as (select {_listed(c for c in KEPT if c not in ("D_63", "D_64"))}, {_flags()} from filled)"""
VALUE_COLUMNS = [c for c in KEPT if c not in (*KEYS, "D_63", "D_64")] + [f'"{f}"' for f in FLAGS]
STATISTIC_COLUMNS = [c for c in VALUE_COLUMNS if c != "B_17"]

HASH = "('0x' || substr(md5('{seed}|' || {key}), 1, 8))::bigint % {n}"
SPLIT = HASH.format(seed=44, key="customer_ID", n=100)
SPLIT_NAME = f"case when {SPLIT} < 80 then 'train' when {SPLIT} < 90 then 'valid' else 'test' end"

LABELS = f"""labels_of_orders as (
  select o_custkey as customer_ID, (max(o_totalprice) > {LABEL_LIMIT})::int as target from orders group by o_custkey)"""

LAGGED = """dated as (select o_custkey as customer_ID, o_orderdate::date as S_2, o_orderkey as row_id from orders),
lagged as (select *, lag(S_2) over (partition by customer_ID order by S_2, row_id) as lag_date from dated)"""


def _months(latest: str, earliest: str) -> str:
    whole = f"(year({latest}) - year({earliest})) * 12 + month({latest}) - month({earliest})"
    def second(x):
        # Whole seconds of the day count, as months_between defines it.
        return f"floor(epoch({x}::timestamp) - epoch(date_trunc('day', {x}::timestamp)))"
    return f"""case when day({latest}) = day({earliest})
        or ({latest}::date = last_day({latest}) and {earliest}::date = last_day({earliest}))
      then 1.0::double * ({whole})
      else round({whole} + ((day({latest}) - day({earliest})) * 86400.0::double
        + {second(latest)} - {second(earliest)}) / (31 * 86400.0::double), 8) end"""


def _gaps(source: str, entity: str, time: str, row: str, exact: bool = False) -> str:
    def places(x):
        return x if exact else f"round({x}, 6)"
    return f"""
    select {entity}, any_value(tenure) as months_tenure,
      {places("coalesce(avg(gap), 0)")} as avg_lag_days, {places("coalesce(stddev_samp(gap), 0)")} as std_lag_days
    from (
      select {entity}, {places(_months("latest", "earliest"))} as tenure, date_diff('day', previous::date, {time}::date) as gap
      from (select {entity}, {time}, lag({time}) over (partition by {entity} order by {time}, {row}) as previous,
              min({time}) over (partition by {entity}) as earliest, max({time}) over (partition by {entity}) as latest
            from {source})
    ) group by {entity}"""


def _mode(column: str, source: str) -> str:
    return f"""
    select customer_ID, {column} as mode_{column} from (
      select customer_ID, {column}, row_number() over (partition by customer_ID order by n desc, first) as place
      from (select customer_ID, {column}, count(*) as n, min(seen) as first from (
        select customer_ID, {column}, row_number() over (partition by customer_ID order by S_2, row_id) as seen
        from {source}) group by all)
    ) where place = 1"""


def _impute(columns) -> str:
    return ", ".join(f"round(coalesce({c}, avg({c}) over ()), 6) as {c}" for c in columns)


def _feature_name(function: str, column: str) -> str:
    return f"{function}_{column.strip(chr(34)).replace('-', '')}_impt".replace("__", "_")


STATISTICS = FILLED + ", statistics as (select customer_ID, " + _listed(
    [f"avg({c}) as {_feature_name('avg', c)}" for c in STATISTIC_COLUMNS]
    + [f"stddev_samp({c}) as {_feature_name('stddev_samp', c)}" for c in STATISTIC_COLUMNS]
) + " from cleaned group by customer_ID), imputed as (select customer_ID, " + _impute(
    [_feature_name(f, c) for f in ("avg", "stddev_samp") for c in STATISTIC_COLUMNS]) + " from statistics)"
FEATURES = STATISTICS + "".join(f", mode_of_{c} as ({_mode(c, 'cleaned')})" for c in MODE_COLUMNS) + f"""
, gaps as ({_gaps('cleaned', 'customer_ID', 'S_2', 'row_id')})"""
FEATURE_SELECT = "select * from imputed " + " ".join(
    f"join mode_of_{c} using (customer_ID)" for c in MODE_COLUMNS) + " join gaps using (customer_ID)"

MODEL_COLUMNS = [_feature_name(f, c) for f in ("avg", "stddev_samp") for c in STATISTIC_COLUMNS] + [
    f"mode_{c}" for c in MODE_COLUMNS] + ["months_tenure", "avg_lag_days", "std_lag_days"]
RAW_STATISTICS = FILLED + ", statistics as (select customer_ID, " + _listed(
    f"{f}({c}) as {_feature_name(f, c)}" for f in ("avg", "stddev_samp") for c in STATISTIC_COLUMNS
) + " from cleaned group by customer_ID), imputed as (select customer_ID, " + _listed(
    f"coalesce({n}, avg({n}) over ()) as {n}" for n in (_feature_name(f, c) for f in ("avg", "stddev_samp") for c in STATISTIC_COLUMNS)
) + " from statistics)"
MODEL = RAW_STATISTICS + "".join(f", mode_of_{c} as ({_mode(c, 'cleaned')})" for c in MODE_COLUMNS) + f"""
, gaps as ({_gaps('cleaned', 'customer_ID', 'S_2', 'row_id', exact=True)}), """ + LABELS + ", features as (" + (
    FEATURE_SELECT + " join labels_of_orders using (customer_ID))")
SCALED = MODEL + f""", scaled as (
  select customer_ID, target, {_listed(
      f"coalesce(({c} - min({c}) over ()) / nullif(max({c}) over () - min({c}) over (), 0), 0) as {c}" for c in MODEL_COLUMNS)}
  from features)"""

NEAREST = SCALED + f""", rarer as (
    select case when sum(target) <= count(*) - sum(target) then 1 else 0 end as label from scaled),
  rare as (select scaled.*, label from scaled join rarer on target = label),
  nearest as (
    select * from (
      select a.customer_ID, b.customer_ID as neighbour,
        {" + ".join(f"(a.{c} - b.{c}) ** 2" for c in MODEL_COLUMNS)} as distance2,
        row_number() over (partition by a.customer_ID order by distance2, b.customer_ID) as rank
      from rare a join rare b on a.customer_ID <> b.customer_ID) where rank <= 5)"""


def _unit(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 13))::bigint / {2**52}::double)"


CORRELATED = [*AMOUNTS, "D_117", "D_126"]
WEIGHT_COLUMNS = [*AMOUNTS, *CODES]
WIDE = [(c, i) for i in range(1, 13) for c in [*AMOUNTS, *CODES[:4]]]
WEIGHTS = PANEL + ", weights as (" + " union all ".join(
    f"select '{c}' as feature, corr({c}, o_totalprice) as weight from panel join orders on row_id = o_orderkey"
    for c in WEIGHT_COLUMNS) + ")"

JUDGED = """with judged as (
  select doc_id, quality as target, n_chars::double as score, (n_chars > 800)::int as predicted
  from labels join documents using (doc_id)
), counts as (select score, sum(target)::bigint as pos, sum(1 - target)::bigint as neg from judged group by score
), curve as (
  select score, pos, neg, (sum(pos) over (order by score desc))::bigint as tp, (sum(neg) over (order by score desc))::bigint as fp,
    (sum(pos) over ())::double as p, (sum(neg) over ())::double as n from counts
)"""
REPORT = """, classes as (
  select label, (sum(support))::bigint as support, sum(hits)::double as hits, sum(claimed)::double as claimed from (
    select target::varchar as label, 1 as support, (target = predicted)::int as hits, 0 as claimed from judged
    union all select predicted::varchar, 0, 0, 1 from judged) group by label
), per_class as (
  select label, hits, support, coalesce(hits / nullif(claimed, 0), 0) as precision,
    coalesce(hits / nullif(support, 0), 0) as recall, coalesce(2 * hits / nullif(claimed + support, 0), 0) as f1
  from classes
)"""
REPORT_ROWS = """
      select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support from per_class
      union all select 'accuracy', null, null, round(sum(hits) / sum(support), 6), sum(support)::bigint from per_class
      union all select 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::bigint from per_class
      union all select 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
        round(sum(f1 * support) / sum(support), 6), sum(support)::bigint from per_class"""

ORACLE_SQL: dict[str, str] = {
    "scan_statements": PANEL + f" select {_listed([*KEYS, 'B_1', 'D_39', 'D_63', 'D_64'])} from panel",
    "sample_entities": "select o_custkey as customer_ID, o_orderdate::date as S_2, o_orderkey as row_id from orders "
                       f"where {HASH.format(seed=0, key='o_custkey', n=100)} < 10",
    "roundtrip_partitioned": PANEL + " select * from panel",
    "wide_means": PANEL + " select case when customer_ID % 10 <> 0 then customer_ID end as customer_ID, " + _listed(
        f"round(avg({c} * {i}), 6) as avg_{c}_{i}" for c, i in WIDE) + " from panel group by 1",
    "impute_median": PANEL + " select customer_ID, S_2, row_id, " + _listed(
        f"round(coalesce({c}, (select quantile_disc({c}, 0.5) from panel)), 6) as {c}" for c in [*AMOUNTS, *CODES]) + " from panel",
    "one_hot_codes": PANEL + """, means as (
      select customer_ID, avg(D_39) as d, avg(coalesce((B_30 = 0)::int, 0)) as b, avg(coalesce((D_116 = 0)::int, 0)) as c
      from panel group by customer_ID)
      select customer_ID, round(coalesce(d, avg(d) over ()), 6) as avg_D_39_impt, round(b, 6) as avg_B_30_0_impt,
        round(c, 6) as avg_D_116_0_impt from means""",
    "feature_null_audit": FEATURES + " select " + " + ".join(
        f"(count(*) > count({c}))::int::bigint" for c in MODEL_COLUMNS) + " as columns_with_nulls from (" + FEATURE_SELECT + ")",
    "quartile_rank_errors": " union all ".join(f"select '{c}' as \"column\", 3 as n_good" for c in [*AMOUNTS, *CODES]),
    "event_lag": """select user_id, event_id, ts, lag(ts) over each as lag_ts,
      date_diff('day', (lag(ts) over each)::date, ts::date)::int as lag_days
      from events window each as (partition by user_id order by ts, event_id)""",
    "lag_without_row_id": """select o_custkey as customer_ID, o_orderdate::date as S_2, lag(o_orderdate::date) over each as lag_date,
      date_diff('day', lag(o_orderdate::date) over each, o_orderdate::date)::int as lag_days
      from orders window each as (partition by o_custkey order by o_orderdate::date)""",
    "outer_join_eight": PANEL + "".join(
        f", table_of_{c} as ({_mode(c, f'panel where {c} is not null')})" for c in MODE_COLUMNS)
        + f" select * from table_of_{MODE_COLUMNS[0]} " + " ".join(
        f"full join table_of_{c} using (customer_ID)" for c in MODE_COLUMNS[1:]),
    "balance_before_after": "with " + LABELS + f""", train as (select target from labels_of_orders where {SPLIT} < 80),
      counts as (select count(*) as n, sum(target)::bigint as ones from train)
      select 'before' as stage, n as n_rows, ones as positives, round(ones / n, 6) as positive_rate from counts
      union all select 'after', 2 * greatest(ones, n - ones), greatest(ones, n - ones), 0.5::double from counts""",
    "model_checks": "with " + LABELS + f""", parted as (select {SPLIT_NAME} as split from labels_of_orders),
      sizes as (select count(*)::double as n, (count(*) filter (split = 'test'))::double as test,
                  (count(*) filter (split = 'valid'))::double as valid from parted)
      select model, "check", value from sizes, lateral (values
        ('logreg', 'rows', test), ('logreg', 'outside', 0.0::double), ('logreg', 'gradient', 0.0::double),
        ('logreg', 'recomputed', 0.0::double), ('dtree', 'rows', test), ('dtree', 'outside', 0.0::double),
        ('rforest', 'rows', test), ('rforest', 'outside', 0.0::double), ('refit', 'rows', valid),
        ('refit', 'outside', 0.0::double), ('refit', 'reloaded', 0.0::double), ('refit', 'beyond limit', 0.0::double),
        ('submission', 'rows', n), ('submission', 'outside', 0.0::double)) as checks(model, "check", value)""",
    "refit_checks": "with " + LABELS + f""", parted as (select {SPLIT_NAME} as split from labels_of_orders)
      select "check", value from (select (count(*) filter (split = 'valid'))::double as valid from parted), lateral (values
        ('gradient', 0.0::double), ('beyond limit', 0.0::double), ('below mean', 0.0::double), ('stronger left out', 0.0::double),
        ('recomputed', 0.0::double), ('support', valid), ('accuracy difference', 0.0::double)) as checks("check", value)""",
    "penalty_checks": "select family, penalty, 0.0::double as slope, penalty in ('l1', 'elasticnet') as leaves_zeros, "
      "penalty <> 'none' as shrinks from (values " + _listed(
          f"('{family}', '{penalty}')" for family, penalties in PENALTIES.items() for penalty in penalties)
      + ") as cases(family, penalty)",
    "report_of_given_weights": MODEL + f""", parted as (select *, {SPLIT_NAME} as split from features),
      ranges as (select {_listed(f"min({c}) as lo_{c}, max({c}) as hi_{c}" for c in ("avg_D_39_impt", "months_tenure"))}
                 from parted where split = 'train'),
      judged as (select target, (1 / (1 + exp(-(-2.5::double
          + 2.5 * (avg_D_39_impt - lo_avg_D_39_impt) / (hi_avg_D_39_impt - lo_avg_D_39_impt)
          + 3.0 * (months_tenure - lo_months_tenure) / (hi_months_tenure - lo_months_tenure)))) > 0.5)::int as predicted
        from parted, ranges where split = 'valid')""" + REPORT + REPORT_ROWS,
    "run_record_checks": f"""select {SEARCH_TRIALS} as n_trials, 1 as first_rank, {SEARCH_TRIALS} as last_rank,
        0 as out_of_order, run, {4 * SEARCH_TRIALS}::bigint as n, {4 * SEARCH_TRIALS}::bigint as n_rows
        from (values ('first'), ('second')) as runs(run)""",
    "search_checks": "with " + LABELS + f""", held as (
        select {HASH.format(seed=1, key='customer_ID', n=5)} as fold from labels_of_orders
        where {SPLIT} < 80 and {HASH.format(seed=0, key='customer_ID', n=100)} < 25)
      select 'fold ' || number as name, count(fold) as n from range(5) as folds(number) left join held on fold = number
      group by number union all select unnest([{_listed(f"'{f}'" for f in FAMILIES)}]), 1""",
    "roundtrip_single_file": "with " + LABELS + " select * from labels_of_orders",
    "selected_features": WEIGHTS + """ select feature from weights
      where abs(weight) >= (select avg(abs(weight)) from weights) order by abs(weight) desc, feature limit 3""",
    "project_columns": PANEL + " select customer_ID, S_2, row_id, D_39 from panel",
    "family_columns": PANEL + " select S_2, S_3, customer_ID, row_id from panel",
    "drop_sparse": PANEL + f" select {_listed(KEPT)} from panel",
    "drop_by_null_rate": PANEL + " select " + _listed(
        c for c in PANEL_COLUMNS if c not in ("D_39", "D_42", "B_39", "D_64")) + " from panel",
    "feature_names": PANEL + " select customer_ID, " + _listed(
        f"round(avg({c}), 6) as avg_{c}_impt" for c in AMOUNTS) + " from panel group by customer_ID",
    "filter_entity": PANEL + " select * from panel where customer_ID = 99",
    "null_key_rows": PANEL + " select customer_ID, S_2, row_id from panel where D_63 is null",
    "describe_by_null": PANEL + " " + " union all ".join(
        _describe("panel", ["B_1", "B_17", "B_30", "B_38"], f"{flag} as is_null", f"where D_64 is {test}")
        for flag, test in (("true", "null"), ("false", "not null"))),
    "table_shape": PANEL + f" select count(*) as n_rows, {len(PANEL_COLUMNS)} as n_columns from panel",
    "preview_rows": PANEL + " select * from panel order by S_2, row_id limit 1000",
    "distinct_values": PANEL + " select distinct D_63, D_64 from panel",
    "clean_panel": FILLED + " select * from cleaned",
    "fill_constants": PANEL + f" select {_listed(_filled(c) for c in PANEL_COLUMNS)} from panel",
    "one_hot": PANEL + ", p as (select customer_ID, S_2, row_id, D_63, D_64 from panel) "
               "select customer_ID, S_2, row_id, "
               "coalesce((D_63 = 'HIGH')::int, 0) as \"D_63_HIGH\", coalesce((D_63 = 'LOW')::int, 0) as \"D_63_LOW\", "
               "coalesce((D_63 = 'MEDIUM')::int, 0) as \"D_63_MEDIUM\", coalesce((D_64 = 'F')::int, 0) as \"D_64_F\" from p",
    "impute_mean": PANEL + f" select customer_ID, S_2, row_id, {_impute([*AMOUNTS, *CODES])} from panel",
    "impute_strategy": PANEL + " select customer_ID, S_2, row_id, " + _listed(
        f"coalesce({c}, (select {c} from panel where {c} is not null group by {c} order by count(*) desc, {c} limit 1)) as {c}"
        for c in CODES) + " from panel",
    "null_column_audit": PANEL + " select " + " + ".join(
        f"(count(*) > count({c}))::int::bigint" for c in PANEL_COLUMNS) + " as columns_with_nulls from panel",
    "key_coverage": """select
      (select count(distinct o_custkey) from orders) as left_keys,
      (select count(distinct c_custkey) from customer) as right_keys,
      (select count(distinct o_custkey) from orders where o_custkey not in (select c_custkey from customer)) as only_left,
      (select count(distinct c_custkey) from customer where c_custkey not in (select o_custkey from orders)) as only_right""",
    "unlabelled_entities": """select distinct o_orderkey as row_id from orders
      where not exists (select 1 from lineitem where l_orderkey = o_orderkey)""",
    "category_counts": PANEL + " " + " union all ".join(
        f"select '{c}' as \"column\", {c}{'::int::varchar' if c not in ('D_63', 'D_64') else ''} as value, count(*) as n "
        f"from panel group by {c}" for c in ("D_63", "D_64", "B_30", "B_38", "D_114", "D_116", "D_120")),
    "duplicate_key_dates": """select o_custkey as customer_ID, o_orderdate::date as S_2, count(*) as same_date_entries
      from orders group by 1, 2 having count(*) > 1""",
    "records_per_date": """select o_orderdate::date as S_2, count(*) as records_per_date from orders
      group by 1 order by 1""",
    "monthly_duplicates": """select o_custkey as customer_ID, month(o_orderdate)::int as month, year(o_orderdate)::int as year,
      count(*) as monthly_records from orders group by 1, 2, 3 having count(*) > 1""",
    "months_observed": """select o_custkey as customer_ID, count(distinct date_trunc('month', o_orderdate)) as months_observed
      from orders group by 1""",
    "category_instability": PANEL + " " + " union all ".join(
        f"select customer_ID, '{c}' as \"column\", count(distinct {c}) as n_values from panel group by customer_ID "
        f"having count(distinct {c}) > 1" for c in ("D_63", "D_64", "B_30", "B_38", "D_114", "D_116", "D_120")),
    "describe_numeric": PANEL + " " + " union all ".join(
        f"select '{c}' as \"column\", count({c}) as n, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as stddev, "
        f"round(min({c}), 6) as min, round(max({c}), 6) as max from panel" for c in [*AMOUNTS, *CODES]),
    "describe_text": PANEL + " " + " union all ".join(
        f"select '{c}' as \"column\", count({c}) as n, min({c}) as min, max({c}) as max from panel" for c in ("D_63", "D_64")),
    "summary_quantiles": PANEL + " " + " union all ".join(
        f"select '{c}' as \"column\", " + _listed(
            f"round(quantile_cont({c}, {q}), 6) as {name}" for name, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)))
        + " from panel" for c in [*AMOUNTS, *CODES]),
    "null_rates": PANEL + " " + " union all ".join(
        f"select '{c}' as \"column\", count(*) - count({c}) as n_null, "
        f"round((count(*) - count({c}))::double / count(*), 6) as null_rate from panel" for c in PANEL_COLUMNS),
    "agg_dict": PANEL + """ select customer_ID, round(avg(D_39), 6) as avg_D_39, round(sum(B_1), 6) as sum_B_1,
      round(min(B_17), 6) as min_B_17, max(S_2) as max_S_2 from panel group by customer_ID""",
    "entity_means": FILLED + " select customer_ID, " + _listed(
        f"round(avg({c}), 6) as \"avg({c.strip(chr(34))})\"" for c in VALUE_COLUMNS) + " from cleaned group by customer_ID",
    "entity_stddevs": FILLED + " select customer_ID, " + _listed(
        f"round(stddev_samp({c}), 6) as \"stddev_samp({c.strip(chr(34))})\"" for c in STATISTIC_COLUMNS)
        + " from cleaned group by customer_ID",
    "class_balance": "with " + LABELS + """
      select 'orders' as source, count(*) as n_rows, sum(target)::bigint as positives,
        round(avg(target), 6) as positive_rate from labels_of_orders
      union all select 'accounts', count(*), sum((c_acctbal < 0)::int)::bigint, round(avg((c_acctbal < 0)::int), 6) from customer""",
    "correlation_pairs": PANEL + " " + " union all ".join(
        f"select '{a}' as first, '{b}' as second, round(corr({a}, {b}), 6) as correlation from panel"
        for i, a in enumerate(CORRELATED) for b in CORRELATED[i + 1:]),
    "correlation_matrix": PANEL + " " + " union all ".join(
        f"select '{a}' as first, '{b}' as second, count(case when {a} is not null and {b} is not null then 1 end) as n, "
        f"round(corr({a}, {b}), 6) as correlation from panel"
        for i, a in enumerate([*AMOUNTS, *CODES]) for b in [*AMOUNTS, *CODES][i + 1:]),
    "date_gap_features": "with dated as (select o_custkey as customer_ID, o_orderdate::date as S_2, o_orderkey as row_id "
                         "from orders)" + _gaps("dated", "customer_ID", "S_2", "row_id"),
    "event_gap_features": _gaps("events", "user_id", "ts", "event_id").strip(),
    "lag_date": "with " + LAGGED + " select * from lagged",
    "lag_days": PANEL + """ select customer_ID, S_2, row_id, D_39,
      coalesce(date_diff('day', lag(S_2) over (partition by customer_ID order by S_2, row_id), S_2), 0)::int as lag_days
      from panel""",
    "bucketed_lags": PANEL + """ select customer_ID, S_2, row_id, D_39,
      coalesce(date_diff('day', lag(S_2) over (partition by customer_ID order by S_2, row_id), S_2), 0)::int as lag_days
      from panel""",
    "bucketed_statistics": PANEL + ", gaps as (" + _gaps("panel", "customer_ID", "S_2", "row_id") + """)
      select customer_ID, """ + ", ".join(f"round(avg({c}), 6) as avg_{c}" for c in AMOUNTS) + """,
      any_value(months_tenure) as months_tenure, any_value(avg_lag_days) as avg_lag_days, any_value(std_lag_days) as std_lag_days
      from panel join gaps using (customer_ID) group by customer_ID""",
    "first_last_date": """select o_custkey as customer_ID, o_orderdate::date as S_2, o_orderkey as row_id,
      min(o_orderdate::date) over (partition by o_custkey) as earliest_date,
      max(o_orderdate::date) over (partition by o_custkey) as latest_date from orders""",
    "months_tenure": f"""select customer_ID, earliest_date, latest_date,
      {_months("latest_date", "earliest_date")} as months_tenure
      from (select o_custkey as customer_ID, min(o_orderdate::date) as earliest_date, max(o_orderdate::date) as latest_date
            from orders group by 1)""",
    "date_span_extras": """select user_id, count(*) as n_records,
      date_diff('day', min(ts)::date, max(ts)::date)::int as span_days from events group by user_id""",
    "calendar_parts": """select o_custkey as customer_ID, o_orderdate::date as S_2, o_orderkey as row_id,
      month(o_orderdate)::int as month, year(o_orderdate)::int as year from orders""",
    "gaps_in_month": "with " + LAGGED + """ select row_id, month(S_2)::int as month,
      date_diff('day', lag_date, S_2)::int as lag_days from lagged where month(S_2) = 9""",
    "mode_first_seen": PANEL + f""", a as ({_mode('D_63', 'panel')}), b as ({_mode('D_64', 'panel')})
      select * from a join b using (customer_ID)""",
    "mode_lowest": """select user_id, event_type as mode_event_type from (
      select user_id, event_type, row_number() over (partition by user_id order by count(*) desc, event_type) as place
      from events group by user_id, event_type) where place = 1""",
    "outer_join_modes": PANEL + f""", first_table as ({_mode('D_63', 'panel where D_63 is not null')}),
      second_table as ({_mode('B_38', 'panel where B_38 is not null')})
      select customer_ID, mode_D_63, mode_B_38 from first_table full join second_table using (customer_ID)""",
    "outer_join_many": PANEL + " select customer_ID, " + _listed(
        f"max(B_1) filter (D_63 = '{level}') as max_{level}" for level in ("HIGH", "LOW", "MEDIUM", "URGENT"))
        + " from panel where D_63 is not null group by customer_ID",
    "feature_table": FEATURES + " " + FEATURE_SELECT,
    "labelled_features": FEATURES + ", " + LABELS + " " + FEATURE_SELECT + " join labels_of_orders using (customer_ID)",
    "minmax_scale": MODEL + f""", parted as (select *, {SPLIT_NAME} as split from features),
      ranges as (select {_listed(f"min({c}) as lo_{c}, max({c}) as hi_{c}" for c in MODEL_COLUMNS)}
                 from parted where split = 'train')
      select customer_ID, target, split,
        {_listed(f"round(coalesce(({c} - lo_{c}) / nullif(hi_{c} - lo_{c}, 0), 0) + 3e-11, 9) as {c}" for c in MODEL_COLUMNS)} from parted, ranges""",
    "minmax_refit": SCALED + " select customer_ID, target, " + _listed(f"round({c} + 3e-11, 9) as {c}" for c in MODEL_COLUMNS) + " from scaled",
    "split_80_10_10": "with " + LABELS + f" select *, {SPLIT_NAME} as split from labels_of_orders",
    "tuning_sample": "with " + LABELS + f" select * from labels_of_orders where {HASH.format(seed=0, key='customer_ID', n=100)} < 25",
    "fold_assignment": "with " + LABELS + f" select *, ({HASH.format(seed=1, key='customer_ID', n=5)})::int as fold from labels_of_orders",
    "smote_neighbours": NEAREST + """ select customer_ID, rank::int as rank, neighbour, round(distance2 + 3e-11, 9) as distance2
      from nearest""",
    "smote_rows": NEAREST + f""",
      sizes as (select count(*) as size, (select count(*) from scaled) - 2 * count(*) as missing from rare),
      drawn as (select *, row_number() over (order by {_unit("'0|' || customer_ID")}, customer_ID) - 1 as position
                from rare, sizes),
      shares as (select customer_ID, label, unnest(generate_series(1,
                   (position + 1) * missing // size - position * missing // size))::int as copy from drawn),
      picks as (select *, floor({_unit("'0|rank|' || customer_ID || '|' || copy")} * 5) + 1 as rank,
                  {_unit("'0|along|' || customer_ID || '|' || copy")} as along from shares)
      select customer_ID, 0 as copy, {_listed(f"round({c} + 3e-11, 9) as {c}" for c in MODEL_COLUMNS)}, target from scaled
      union all select p.customer_ID, p.copy,
        {_listed(f"round(a.{c} + along * (b.{c} - a.{c}) + 3e-11, 9)" for c in MODEL_COLUMNS)}, p.label
      from picks p join nearest n on n.customer_ID = p.customer_ID and n.rank = p.rank
        join rare a on a.customer_ID = p.customer_ID join rare b on b.customer_ID = n.neighbour""",
    "pipeline_reload": MODEL + """ select model, count(*) as n_rows, 0.0::double as difference
      from features, (values ('logreg'), ('rforest'), ('dtree')) as kinds(model) group by model""",
    "neighbour_recall": MODEL + " select count(*) as n_rows, true as reaches_nine_tenths from features",
    "feature_matrix": MODEL + f" select customer_ID, target, {len(MODEL_COLUMNS)} as width, " + _listed(
        f"round({c}, 6) as feature_{i}" for i, c in enumerate(MODEL_COLUMNS)) + " from features",
    "accuracy": JUDGED + " select round(avg((target = predicted)::int), 6) as accuracy from judged",
    "confusion_matrix": JUDGED + " select target, predicted, count(*) as n from judged group by 1, 2",
    "classification_report": JUDGED + REPORT + REPORT_ROWS,
    "roc_points": JUDGED + """ select score as threshold, tp, fp, round(tp / p, 6) as tpr, round(fp / n, 6) as fpr from curve""",
    "pr_points": JUDGED + """ select score as threshold, round(tp::double / (tp + fp), 6) as precision,
      round(tp / p, 6) as recall from curve""",
    "auc": JUDGED + " select round(sum(neg * (tp - pos / 2.0::double)) / (max(p) * max(n)), 6) as auc from curve",
    "auc_bounded": JUDGED + """ select round(sum(neg * (tp - pos / 2.0::double)) / (max(p) * max(n)), 6) as auc,
      true as within_error, true as error_below_share, true as bounded from curve""",
    "roc_points_bounded": JUDGED + """ select true as bounded, 0 as off_curve, 1.0::double as last_tpr, 1.0::double as last_fpr
      from (select count(*) from curve)""",
    "top_coefficients": WEIGHTS + """ select feature, round(weight, 6) as weight from weights
      where abs(weight) >= (select avg(abs(weight)) from weights) order by abs(weight) desc, feature limit 4""",
    "score_linear": SCALED + """ select customer_ID, round_even(1 / (1 + exp(-(-3.0::double + 2.5 * avg_D_39_impt
      + 1.25 * stddev_samp_D_39_impt - 0.5 * mode_B_38 + 3.0 * months_tenure - 0.75 * avg_lag_days))), 2) as prediction
      from scaled""",
}
