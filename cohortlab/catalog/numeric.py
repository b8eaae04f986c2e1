"""SQL for what has no closed form: tails of the normal distribution, and roots by bisection on noncentral distributions."""

from __future__ import annotations


def two_sided_p(z: str) -> str:
    """The normal distribution beyond z on both sides, by Simpson's rule over 14 deviations."""
    term = f"(case when k = 0 or k = 2000 then 1 when k % 2 = 1 then 4 else 2 end) * exp(-power({z} + k * 0.007, 2) / 2)"
    return f"sqrt(2 / pi()) * list_sum(list_transform(range(0, 2001), lambda k: {term})) * 0.007 / 3"


#: Tails of the noncentral distribution whose log weights are ``lw`` at ``i``; each rises with the log odds.
KINDS = {
    "est": "m - a",
    "exact_low": "above + same - 0.025",
    "mid_low": "above + same / 2 - 0.025",
    "exact_high": "0.025 - below - same",
    "mid_high": "0.025 - below - same / 2",
}


def conditional_odds(weights: str, key: str, extra: str = "") -> str:
    """Common table expressions up to ``odds``: key, and the conditional odds ratio with its limits. ``weights`` selects key,
    a (the observed sum), i and lw."""
    share = lambda test: f"coalesce(list_sum(list_transform(list_filter(range(1, len(i) + 1), lambda j: i[j] {test} a), lambda j: w[j])), 0) / list_sum(w)"
    value = "case kind " + " ".join(f"when '{k}' then {f}" for k, f in KINDS.items()) + " end"
    pick = lambda k, able: f"max(case when kind = '{k}' then {able} end)"
    return f"""
  lists as (select {key}, any_value(a) as a, list(i order by i) as i, list(lw order by i) as lw from ({weights}) group by {key}),
  kinds as (select *, unnest({list(KINDS)}) as kind from lists),
  r as (select {key}, kind, 0 as step, -40.0 :: double as lo, 40.0 :: double as hi from kinds union all
    select {key}, kind, step + 1, case when f < 0 then mid else lo end, case when f < 0 then hi else mid end from (
      select *, {value} as f from (
        select *, {share('<')} as below, {share('=')} as same, {share('>')} as above, list_sum(list_transform(range(1, len(i) + 1), lambda j: w[j] * i[j])) / list_sum(w) as m from (
          select *, list_transform(e, lambda x: exp(x - list_max(e))) as w from (
            select r.*, (lo + hi) / 2 as mid, a, i, list_transform(range(1, len(i) + 1), lambda j: lw[j] + i[j] * (lo + hi) / 2) as e from r join kinds using ({key}, kind) where step < 64))))),
  odds as (select {key}, {pick('est', "case when a = i[1] then 0.0 when a = i[len(i)] then 'inf' :: double else exp(lo) end")} as estimate,
    {pick('exact_low', 'case when a > i[1] then exp(lo) end')} as exact_low, {pick('exact_high', 'case when a < i[len(i)] then exp(lo) end')} as exact_high,
    {pick('mid_low', 'case when a > i[1] then exp(lo) end')} as mid_low, {pick('mid_high', 'case when a < i[len(i)] then exp(lo) end')} as mid_high
    from r join lists using ({key}) where step = 64 and len(i) > 1 group by {key}){extra}"""


#: Log weights of the upper left cell i of a fourfold table with margins as in t.
SUPPORT = "select *, unnest(generate_series(greatest(0, a + b + a + c - (a + b + c + d)), least(a + b, a + c))) as i from t"
LOG_WEIGHT = "-lgamma(i + 1) - lgamma(a + b - i + 1) - lgamma(a + c - i + 1) - lgamma(d - a + i + 1)"
