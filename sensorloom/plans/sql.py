"""SQL text of the test shapes, written for an engine other than Spark (the oracle side)."""

from __future__ import annotations

from collections.abc import Iterable

from ..operators.resample import MIX, STEPS
from ..sources.fixtures import N_SENSORS, SENSORS, missing_modulus

ALL = range(N_SENSORS)


def _value(i: int) -> str:
    e = f"cast(embedding[{i + 1}] as double)"
    if i == 5:
        e = "cast(1.0 as double)"
    if i == 9:
        e = "2 * cast(embedding[9] as double) + 1"
    if i == 13:
        e = f"{e} + vec_id * cast(0.01 as double)"
    return f"case when (vec_id * 7 + {i // 2 * 26}) % 100 < {missing_modulus(i)} then null else {e} end"


WAFER = (
    "wafer as (select timestamp '2008-07-19 00:00:00' + to_minutes(cast((vec_id // 2) * 131 as bigint)) as measurement_ts, "
    "vec_id as raw_row_id, case when label = 0 then 1 else 0 end as target, "
    + ", ".join(f"{_value(i)} as c_{i}" for i in ALL)
    + " from embeddings)"
)

# long form of the sensors; needs WAFER
CELLS = (
    "cells as (select raw_row_id, measurement_ts, target, sensor, value from wafer "
    f"unpivot include nulls (value for sensor in ({', '.join(SENSORS)})))"
)

# Profile from the different values of each sensor and how often each occurs.
PROFILE = """values_seen as (select sensor, value, count(*) as times from cells group by all),
centres as (select sensor, sum(value * times) / sum(times) as centre, sum(times) as present, count(*) as kinds
            from values_seen where value is not null group by sensor),
spreads as (select sensor, sum(times * power(value - centre, 2)) / any_value(present) as raw_variance
            from values_seen join centres using (sensor) where value is not null group by sensor),
rows_of as (select sensor, sum(times)::bigint as total from values_seen group by sensor),
profile as (
  select r.sensor as column_name, r.total as n_rows, (r.total - coalesce(c.present, 0))::bigint as n_null,
         1 - coalesce(c.present, 0) / r.total::double as missing_rate, coalesce(c.kinds, 0) as n_distinct, v.raw_variance
  from rows_of r left join centres c using (sensor) left join spreads v using (sensor))"""

# Stays: a null share under a tenth and more than one value.
KEPT = """kept as (
  select column_name as sensor, n_null > 0 as has_missing from profile where 10 * n_null < n_rows and raw_variance > 0)"""

# the first 80 % by time is train
ERA = """era as (
  select raw_row_id, measurement_ts, target,
         case when row_number() over (order by measurement_ts, raw_row_id)
                   > count(*) over () - greatest(1, cast(round_even(0.2 * count(*) over (), 0) as bigint))
              then 'test' else 'train' end as split
  from wafer)"""

TELEMETRY = """telemetry as (
  select event_id as id, ts, user_id as tool, case when event_id % 7 = 0 then null else value end as value,
         case when event_type = 'error' then 1 else 0 end as target from events)"""

SCORES = """scores as (
  select pipeline, cast(doc_id % 5 as int) as fold, doc_id as id, toxic as y_true,
         cast((doc_id * m) % 97 + toxic * 30 as double) / cast(650 as double) as y_score
  from labels, (values ('alpha', 37), ('beta', 41), ('gamma', 43)) p(pipeline, m))"""

EVENT_SCORES = """scores as (
  select event_id as id, case when event_type = 'error' then 1 else 0 end as y_true,
         least(value / cast(500 as double), cast(1 as double)) as y_score from events)"""


def r6(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + cast(0 as double))"


def with_(*ctes: str, final: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + final


def values(rows: Iterable[tuple], name: str, cols: str) -> str:
    """A literal table as a CTE."""

    def lit(v: object) -> str:
        if v is None:
            return "null"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, float):
            return f"cast({v!r} as double)"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return str(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"{name}({cols}) as (values {body})"


# Cells of a key that the SQL of the bootstrap can hold, as a power of two.
BOOT_LEVELS = 8


def bootstrap(scores: str, n_boot: int, tag: str = "", seed: int = 42, levels: int = BOOT_LEVELS) -> tuple[str, ...]:
    """Tables up to `per_draw{tag}` (pipeline, draw, pr_auc, roc_auc, ber_percent), from `scores` with a column `hit`.

    The class totals of each draw are split down a binary tree over the cells of a key, highest score first. A split is
    binomial: outcomes in order of their distance from the mode, the higher first, take their mass from one number of a
    hash stream.
    """
    t, big = tag, "18446744073709551616::uhugeint"
    mult = [f"{x}::uhugeint" for x in STEPS]
    out = [
        f"boot_merged{t} as (select pipeline, y_score, sum(y_true)::bigint as pos, sum(1 - y_true)::bigint as neg, bool_or(hit) as hit from {scores} group by 1, 2)",
        f"boot_cells{t} as (select *, row_number() over (partition by pipeline order by y_score desc) - 1 as j from boot_merged{t})",
        f"""boot_sums{t}_0 as (select pipeline, v.cls, j, v.w, ('0x' || substr(md5('{seed}:' || pipeline), 1, 15))::uhugeint as h
            from boot_cells{t}, lateral (values (1, pos), (0, neg)) v(cls, w) where v.w > 0)""",
    ]
    for i in range(1, levels + 1):
        out.append(f"boot_sums{t}_{i} as (select pipeline, cls, j // 2 as j, sum(w)::bigint as w, h from boot_sums{t}_{i - 1} group by pipeline, cls, j // 2, h)")
    out.append(f"boot_at{t}_{levels} as materialized (select pipeline, cls, h, draw, j, w as r from boot_sums{t}_{levels}, generate_series(1, {n_boot}) g(draw))")
    for i in range(levels, 0, -1):
        out += [
            # the share of the left half; where one half has all there is nothing to draw
            f"""boot_p{t}_{i} as (select s.pipeline, s.cls, s.j, s.h, coalesce(l.w, 0)::double / s.w as p
                from boot_sums{t}_{i} s left join boot_sums{t}_{i - 1} l on l.pipeline = s.pipeline and l.cls = s.cls and l.j = 2 * s.j)""",
            f"""boot_x{t}_{i} as materialized (select pipeline, cls, draw, j, h, r, p,
                  ((h + cls::uhugeint * {mult[0]} + draw::uhugeint * {mult[1]} + {i}::uhugeint * {mult[2]} + j::uhugeint * {mult[3]}) % {big})::ubigint as x0
                from boot_at{t}_{i} join boot_p{t}_{i} using (pipeline, cls, j, h))""",
            f"boot_y{t}_{i} as (select *, ((xor(x0, x0 >> 30)::uhugeint * {MIX[0]}::uhugeint) % {big})::ubigint as x1 from boot_x{t}_{i} where p > 0 and p < 1)",
            f"boot_z{t}_{i} as (select *, ((xor(x1, x1 >> 27)::uhugeint * {MIX[1]}::uhugeint) % {big})::ubigint as x2 from boot_y{t}_{i})",
            f"boot_u{t}_{i} as (select pipeline, cls, draw, j, r, (xor(x2, x2 >> 31) >> 11)::double / 9007199254740992.0::double as u from boot_z{t}_{i})",
            f"""boot_k{t}_{i} as (select pipeline, cls, j, r, p, k, least(floor((r + 1) * p), r)::bigint as m
                from (select distinct pipeline, cls, j, r, p from boot_y{t}_{i}), lateral (select unnest(range(0, r + 1)) as k))""",
            f"""boot_m{t}_{i} as (select *, exp(lgamma(r + 1) - lgamma(k + 1) - lgamma(r - k + 1) + k * ln(p) + (r - k) * ln(1 - p)) as mass,
                  case when k > m then 2 * (k - m) - 1 else 2 * (m - k) end as o from boot_k{t}_{i})""",
            f"boot_c{t}_{i} as (select *, sum(mass) over (partition by pipeline, cls, j, r order by o rows unbounded preceding) as upto from boot_m{t}_{i})",
            f"""boot_w{t}_{i} as (select u.pipeline, u.cls, u.draw, u.j, coalesce(min_by(c.k, c.o), any_value(least(floor((u.r + 1) * y.p), u.r)::bigint)) as k
                from boot_u{t}_{i} u join boot_p{t}_{i} y using (pipeline, cls, j)
                left join boot_c{t}_{i} c on c.pipeline = u.pipeline and c.cls = u.cls and c.j = u.j and c.r = u.r and c.upto > u.u group by all)""",
            f"""boot_s{t}_{i} as (select x.pipeline, x.cls, x.h, x.draw, x.j, x.r, case when x.p = 0 then 0 when x.p = 1 then x.r else w.k end as k
                from boot_x{t}_{i} x left join boot_w{t}_{i} w on w.pipeline = x.pipeline and w.cls = x.cls and w.draw = x.draw and w.j = x.j)""",
            f"""boot_at{t}_{i - 1} as materialized (select * from (
                  select pipeline, cls, h, draw, 2 * j as j, k as r from boot_s{t}_{i} union all select pipeline, cls, h, draw, 2 * j + 1, r - k from boot_s{t}_{i}) where r > 0)""",
        ]
    out += [
        f"""boot_drawn{t} as (select a.pipeline, draw, j, any_value(hit) as hit, sum(case when cls = 1 then r else 0 end) as pos, sum(case when cls = 0 then r else 0 end) as neg
            from boot_at{t}_0 a join boot_cells{t} c using (pipeline, j) group by a.pipeline, draw, j)""",
        f"""boot_ranked{t} as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over (partition by pipeline, draw) as p, sum(neg) over (partition by pipeline, draw) as n
            from boot_drawn{t} window w as (partition by pipeline, draw order by j rows unbounded preceding))""",
        f"""per_draw{t} as (select pipeline, draw, sum(pos * (tp::double / (tp + fp))) / min(p) as pr_auc, (sum(pos * (neg / 2.0::double - fp)) + min(p)::double * min(n)) / (min(p)::double * min(n)) as roc_auc,
            100 * (1 - (coalesce(sum(pos) filter (hit), 0) / min(p)::double + (min(n) - coalesce(sum(neg) filter (hit), 0)) / min(n)::double) / 2) as ber_percent
            from boot_ranked{t} group by pipeline, draw having min(p) > 0 and min(n) > 0)""",
    ]
    return tuple(out)


def intervals(stats: Iterable[str]) -> str:
    return ", ".join(f"{r6(f'quantile_cont({s}, {q})')} as {s}_{t}" for s in stats for t, q in (("median", 0.5), ("ci_low", 0.025), ("ci_high", 0.975)))
