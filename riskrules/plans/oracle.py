"""DuckDB SQL stating the expected answer of each registered query.

Written independently of the Spark code from the definitions in the
README; the ``tx`` CTE is the same view as ``sources.fixtures.tx_frame``.
Money sums go through DECIMAL(18,2) exactly as on the Spark side.
"""

from __future__ import annotations

from ..roles import Params
from ..sources.fixtures import TX_SQL

P = Params()
T0, TN = P.amount_thresholds[0], P.amount_thresholds[-1]

MONEY = "DECIMAL(18,2)"


def msum(expr: str) -> str:
    return f"CAST(SUM(CAST({expr} AS {MONEY})) AS DOUBLE)"


FRAUD_AMT = "CASE WHEN is_fraud = 1 THEN amount ELSE 0 END"

BUCKET_SQL = (
    "CASE WHEN amount <= 3000 THEN 0 WHEN amount <= 10000 THEN 1 WHEN amount <= 25000 THEN 2 "
    "WHEN amount <= 50000 THEN 3 WHEN amount <= 100000 THEN 4 WHEN amount > 100000 THEN 5 END"
)

TX_COLS = [
    "mch_id_trimmed", "issuer_member", "part_id", "amount", "is_fraud", "fraud_score", "cs",
    "ship_address_usage_ind", "card_profile_dep", "bill_count", "merchant_country_code",
    "issuer_bin_profile_issuing_cou", "trans_status", "three_ds_mode",
]

BASE = f"tx AS ({TX_SQL})"
BAND = f"band AS (SELECT *, {BUCKET_SQL} AS amount_bucket FROM tx WHERE fraud_score >= 50 AND fraud_score < 70)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join((BASE, *ctes)) + "\n"


def profile_sql(key: str, kind: str) -> tuple[str, list[str]]:
    if kind == "generic":
        n = {"rate": f"{key}_fraud_rate", "count": f"{key}_tx_count", "avg": f"{key}_avg_amount",
             "std": f"{key}_std_amount", "amount_rate": f"{key}_fraud_amount_rate"}
    else:
        n = {"rate": f"{kind}_fraud_rate", "count": f"{kind}_tx_count", "avg": f"{kind}_avg_amount",
             "std": f"{kind}_amount_std", "amount_rate": f"{kind}_fraud_amount_rate"}
    sel = [
        f"AVG(CAST(is_fraud AS DOUBLE)) AS {n['rate']}",
        f"COUNT(*) AS {n['count']}",
        f"{msum('amount')} / COUNT(amount) AS {n['avg']}",
        f"ROUND(STDDEV_SAMP(amount), 4) AS {n['std']}",
        f"{msum(FRAUD_AMT)} / NULLIF({msum('amount')}, 0) AS {n['amount_rate']}",
    ]
    names = [n["rate"], n["count"], n["avg"], n["std"], n["amount_rate"]]
    if kind == "merchant":
        sel += [
            f"AVG(CASE WHEN amount <= {T0} THEN CAST(is_fraud AS DOUBLE) END) AS merchant_small_amount_fraud_rate",
            f"AVG(CASE WHEN amount > {TN} THEN CAST(is_fraud AS DOUBLE) END) AS merchant_large_amount_fraud_rate",
        ]
        names += ["merchant_small_amount_fraud_rate", "merchant_large_amount_fraud_rate"]
    if kind == "issuer":
        xb = "(CASE WHEN issuer_bin_profile_issuing_cou <> merchant_country_code THEN 1 ELSE 0 END)"
        sel += [
            "AVG(CASE WHEN trans_status = 'Y' THEN 1.0 ELSE 0.0 END::DOUBLE) AS issuer_auth_rate",
            "AVG(CASE WHEN three_ds_mode <> 'N' THEN 1.0 ELSE 0.0 END::DOUBLE) AS issuer_3ds_usage_rate",
            f"AVG(CAST({xb} AS DOUBLE)) AS issuer_cross_border_rate",
            f"AVG(CASE WHEN {xb} = 1 THEN CAST(is_fraud AS DOUBLE) END) AS issuer_cross_border_fraud_rate",
        ]
        names += ["issuer_auth_rate", "issuer_3ds_usage_rate", "issuer_cross_border_rate", "issuer_cross_border_fraud_rate"]
    body = f"SELECT {key},\n  " + ",\n  ".join(sel) + f"\nFROM tx GROUP BY {key}"
    return body, names


PROFILES = {
    "mch_id_trimmed": ("merchant", "merchant_fraud_rate", "merchant_risk_tier"),
    "issuer_member": ("issuer", "issuer_fraud_rate", "issuer_risk_tier"),
    "part_id": ("generic", "part_id_fraud_rate", "part_id_risk_tier"),
}


def bins_cte(key: str) -> str:
    kind, rate, _ = PROFILES[key]
    body, _ = profile_sql(key, kind)
    return (
        f"p AS ({body}),\n"
        f"b AS (SELECT list_sort(list_distinct(quantile_cont(r, [0.0, 0.5, 0.9, 0.95, 1.0]))) AS bins "
        f"FROM (SELECT DISTINCT {rate} AS r FROM p WHERE {rate} IS NOT NULL))"
    )


def tier_case(rate: str) -> str:
    below = " + ".join(
        f"(CASE WHEN len(bins) >= {k} AND bins[{k}] < {rate} THEN 1 ELSE 0 END)" for k in range(1, 6)
    )
    return (
        f"CASE WHEN {rate} IS NULL OR bins IS NULL OR len(bins) < 2 THEN 'unknown' "
        f"WHEN ({below}) >= len(bins) THEN 'unknown' "
        f"WHEN ({below}) <= 1 THEN 'low' WHEN ({below}) = 2 THEN 'medium' "
        f"WHEN ({below}) = 3 THEN 'high' ELSE 'very_high' END"
    )


def q_profile(key: str) -> str:
    body, _ = profile_sql(key, PROFILES[key][0])
    return with_() + body


def q_attach(key: str) -> str:
    body, names = profile_sql(key, PROFILES[key][0])
    cols = ", ".join(f"tx.{c}" for c in TX_COLS) + ", " + ", ".join(f"p.{c}" for c in names)
    return with_(f"p AS ({body})") + f"SELECT {cols} FROM tx LEFT JOIN p ON tx.{key} = p.{key}"


def q_without_self(key: str) -> str:
    """Window sums over the entity, less the row's own share, for measures that hold the label."""
    kind, rate, _ = PROFILES[key]
    body, names = profile_sql(key, kind)
    money = lambda e: f"CAST({e} AS {MONEY})"
    less = lambda e: f"CAST(SUM({money(e)}) OVER w - {money(e)} AS DOUBLE)"

    def others(cond: str) -> str:
        y = f"CASE WHEN {cond} THEN is_fraud END"
        return f"CAST(SUM({y}) OVER w - COALESCE({y}, 0) AS DOUBLE) / NULLIF(COUNT({y}) OVER w - COUNT({y}) OVER one, 0)"

    new = {
        rate: others("TRUE"),
        rate.replace("_rate", "_amount_rate"): f"{less(FRAUD_AMT)} / NULLIF({less('amount')}, 0)",
        "merchant_small_amount_fraud_rate": others(f"amount <= {T0}"),
        "merchant_large_amount_fraud_rate": others(f"amount > {TN}"),
        "issuer_cross_border_fraud_rate": others("issuer_bin_profile_issuing_cou <> merchant_country_code"),
    }
    made = ", ".join(f"{e} AS {c}" for c, e in new.items() if c in names)
    kept = ", ".join(f"p.{c}" for c in names if c not in new)
    return with_(
        f"p AS ({body})",
        "numbered AS (SELECT *, ROW_NUMBER() OVER () AS i FROM tx)",
        f"o AS (SELECT *, {made} FROM numbered WINDOW w AS (PARTITION BY {key}), one AS (PARTITION BY i))",
    ) + f"SELECT o.* EXCLUDE (i), {kept} FROM o LEFT JOIN p ON o.{key} = p.{key}"


def q_tier(key: str) -> str:
    _, rate, tier = PROFILES[key]
    return with_(bins_cte(key)) + f"SELECT {key}, {rate}, {tier_case(rate)} AS {tier} FROM p, b"


def q_risk_bins() -> str:
    parts = []
    for key in PROFILES:
        _, rate, _ = PROFILES[key]
        body, _ = profile_sql(key, PROFILES[key][0])
        parts.append(
            f"SELECT '{key}' AS entity, CAST(i - 1 AS INTEGER) AS edge_index, ROUND(bins[i], 12) AS edge "
            f"FROM (SELECT list_sort(list_distinct(quantile_cont(r, [0.0, 0.5, 0.9, 0.95, 1.0]))) AS bins "
            f"FROM (SELECT DISTINCT {rate} AS r FROM ({body}) WHERE {rate} IS NOT NULL)) b, "
            f"range(1, len(bins) + 1) t(i)"
        )
    return with_() + "\nUNION ALL\n".join(parts)


def onehot_sql(feature: str, slots: int, prefix: str, value_expr: str, source: str, weight: str = "COUNT(*)") -> tuple[str, str]:
    """CTE ranking the values of ``feature`` (frequency desc, text asc) and the
    0/1 slot columns."""
    cte = (
        f"idx_{feature} AS (SELECT v, CAST(ROW_NUMBER() OVER (ORDER BY n DESC, v ASC) - 1 AS INTEGER) AS i "
        f"FROM (SELECT {value_expr} AS v, {weight} AS n FROM {source} WHERE {value_expr} IS NOT NULL GROUP BY 1))"
    )
    cols = ", ".join(
        f"CAST(CASE WHEN idx_{feature}.i = {k} THEN 1 ELSE 0 END AS DOUBLE) AS {prefix}_{k}" for k in range(slots)
    )
    return cte, cols


def q_onehot() -> str:
    c1, cols1 = onehot_sql("card_profile_dep", 5, "card_profile_dep_vec", "card_profile_dep", "tx")
    c2, cols2 = onehot_sql("ship_address_usage_ind", 7, "ship_address_usage_ind_vec", "ship_address_usage_ind", "tx")
    return with_(c1, c2) + (
        f"SELECT tx.mch_id_trimmed, tx.amount, tx.card_profile_dep, tx.ship_address_usage_ind, {cols1}, {cols2} "
        "FROM tx LEFT JOIN idx_card_profile_dep ON tx.card_profile_dep = idx_card_profile_dep.v "
        "LEFT JOIN idx_ship_address_usage_ind ON tx.ship_address_usage_ind = idx_ship_address_usage_ind.v"
    )


def q_tier_onehot() -> str:
    tier = tier_case("merchant_fraud_rate")
    pt = f"pt AS (SELECT mch_id_trimmed, merchant_tx_count, {tier} AS merchant_risk_tier FROM p, b)"
    c, cols = onehot_sql(
        "tier", 4, "merchant_risk_tier_enc",
        "CASE WHEN mch_id_trimmed IS NULL THEN 'unknown' ELSE merchant_risk_tier END", "pt", "SUM(merchant_tx_count)",
    )
    return with_(bins_cte("mch_id_trimmed"), pt, c) + (
        f"SELECT tx.mch_id_trimmed, tx.amount, tx.is_fraud, pt.merchant_risk_tier, {cols} "
        "FROM tx LEFT JOIN pt ON tx.mch_id_trimmed = pt.mch_id_trimmed "
        "LEFT JOIN idx_tier ON COALESCE(pt.merchant_risk_tier, 'unknown') = idx_tier.v"
    )


ONEHOT = ("ship_address_usage_ind", "card_profile_dep", "bill_count")


def slot_queries() -> dict[str, str]:
    """The slot of every tier and category of the band, ranked over the whole population."""
    ctes, joins, slots, names = [BAND], [], [], []
    for key, (kind, rate, tier) in PROFILES.items():
        count = profile_sql(key, kind)[1][1]
        ctes.append(
            f"pt_{key} AS (WITH {bins_cte(key)} SELECT {key}, {count} AS n, {tier_case(rate)} AS {tier} FROM p, b)"
        )
        ctes.append(onehot_sql(tier, 0, "", f"CASE WHEN {key} IS NULL THEN 'unknown' ELSE {tier} END", f"pt_{key}", "SUM(n)")[0])
        joins.append(f"LEFT JOIN pt_{key} ON band.{key} = pt_{key}.{key} LEFT JOIN idx_{tier} ON COALESCE({tier}, 'unknown') = idx_{tier}.v")
        slots.append((f"{tier}_enc", f"idx_{tier}"))
        names.append(tier)
    for c in ONEHOT:
        text = f"CASE WHEN CAST({c} AS VARCHAR) = '' THEN '__empty__' ELSE CAST({c} AS VARCHAR) END"
        ctes.append(onehot_sql(c, 0, "", text, "tx")[0])
        joins.append(f"LEFT JOIN idx_{c} ON {text} = idx_{c}.v")
        slots.append((f"{c}_vec", f"idx_{c}"))
    shown = ", ".join(f"CAST({idx}.i AS BIGINT) AS {col}_slot" for col, idx in slots)
    rows = f"SELECT band.mch_id_trimmed, amount, is_fraud, {', '.join((*ONEHOT, *names))}, {shown} FROM band {' '.join(joins)}"
    counts = "\nUNION ALL\n".join(
        f"SELECT '{col}' AS source, {idx}.i AS slot, {idx}.v AS label, COUNT(s.{col}_slot) AS n "
        f"FROM {idx} LEFT JOIN s ON s.{col}_slot = {idx}.i GROUP BY ALL"
        for col, idx in slots
    )
    return {"slot_rows": with_(*ctes) + rows, "slot_counts": with_(*ctes, f"s AS ({rows})") + counts}


def q_cardinality() -> str:
    parts = [
        f"SELECT '{f}' AS feature, COUNT(DISTINCT {f}) + MAX(CASE WHEN {f} IS NULL THEN 1 ELSE 0 END) AS n_distinct FROM tx"
        for f in ("ship_address_usage_ind", "card_profile_dep", "bill_count", "part_id")
    ]
    return with_() + "\nUNION ALL\n".join(parts)


FREQ = "SELECT part_id, COUNT(*) / (SELECT COUNT(*) FROM tx) AS part_id_freq FROM tx GROUP BY part_id"

RANGES = ", ".join(f"CAST(CASE WHEN amount_bucket = {i} THEN 1 ELSE 0 END AS DOUBLE) AS amount_range_{i}" for i in range(6))

# ---- rules with cs >= 0.35 as the flag, mining (bucket, cs, card_profile_dep) -------------

PAT = (
    "pat AS (SELECT amount_bucket, ROUND(cs, 1) AS cs, card_profile_dep, COUNT(*) AS support FROM band "
    "WHERE cs >= 0.35 AND amount_bucket IS NOT NULL GROUP BY 1, 2, 3 HAVING COUNT(*) >= 50)"
)
RUL = (
    "r AS (SELECT *, ROUND(GREATEST(0.0, cs - 0.05), 3) AS score_lo, ROUND(LEAST(1.0, cs + 0.05), 3) AS score_hi, "
    "CAST(CASE amount_bucket WHEN 0 THEN NULL WHEN 1 THEN 3000 WHEN 2 THEN 10000 WHEN 3 THEN 25000 "
    "WHEN 4 THEN 50000 ELSE 100000 END AS DOUBLE) AS amount_lo, "
    "CAST(CASE amount_bucket WHEN 0 THEN 3000 WHEN 1 THEN 10000 WHEN 2 THEN 25000 WHEN 3 THEN 50000 "
    "WHEN 4 THEN 100000 ELSE NULL END AS DOUBLE) AS amount_hi FROM pat)"
)
AMOUNT_TEXT = (
    "CASE amount_bucket WHEN 0 THEN 'event.amount <= 3000.0' "
    "WHEN 1 THEN 'event.amount > 3000.0 AND event.amount <= 10000.0' "
    "WHEN 2 THEN 'event.amount > 10000.0 AND event.amount <= 25000.0' "
    "WHEN 3 THEN 'event.amount > 25000.0 AND event.amount <= 50000.0' "
    "WHEN 4 THEN 'event.amount > 50000.0 AND event.amount <= 100000.0' "
    "ELSE 'event.amount > 100000.0' END"
)
RULE_TEXT = (
    f"({AMOUNT_TEXT}) || ' AND event.cs >= ' || printf('%.3f', score_lo) || ' AND event.cs < ' || "
    "printf('%.3f', score_hi) || ' AND event.card_profile_dep = ''' || card_profile_dep || ''''"
)
EVAL = (
    "ev AS (SELECT r.amount_bucket, r.cs, r.card_profile_dep, r.support, r.score_lo, r.score_hi, r.amount_lo, r.amount_hi, "
    f"COUNT(b.amount_bucket) AS num_transactions, "
    "CAST(COALESCE(SUM(CAST(b.is_fraud AS INTEGER)), 0) AS BIGINT) AS num_frauds, "
    f"COALESCE(CAST(SUM(CAST(CASE WHEN b.is_fraud = 1 THEN b.amount ELSE 0 END AS {MONEY})) AS DOUBLE), 0.0) AS captured_fraud_amount "
    "FROM r LEFT JOIN band b ON b.amount_bucket = r.amount_bucket AND b.card_profile_dep = r.card_profile_dep "
    "AND b.cs >= r.score_lo AND b.cs < r.score_hi "
    "GROUP BY r.amount_bucket, r.cs, r.card_profile_dep, r.support, r.score_lo, r.score_hi, r.amount_lo, r.amount_hi)"
)
TOTAL = f"tot AS (SELECT COALESCE({msum(FRAUD_AMT)}, 0.0) AS total_fraud_amount FROM band)"
MET = (
    "m AS (SELECT ev.*, CASE WHEN num_transactions > 0 THEN num_frauds / num_transactions ELSE 0.0 END AS precision, "
    "CASE WHEN total_fraud_amount > 0 THEN captured_fraud_amount / total_fraud_amount ELSE 0.0 END AS amount_recall "
    "FROM ev, tot)"
)
KEPT = "k AS (SELECT * FROM m WHERE precision >= 0.3)"
RANKED = (
    "rk AS (SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY amount_recall DESC, amount_bucket ASC, "
    "cs ASC NULLS FIRST, card_profile_dep ASC NULLS FIRST) AS INTEGER) AS rank, "
    f"{RULE_TEXT} AS rule_string FROM k)"
)
SEL = "sel AS (SELECT * FROM rk WHERE rank <= 5)"
RULE_CTES = (BAND, PAT, RUL, EVAL, TOTAL, MET, KEPT, RANKED, SEL)
METRICS = "amount_bucket, cs, card_profile_dep, support, num_transactions, num_frauds, captured_fraud_amount, precision, amount_recall"
RS_METRICS = (
    "SELECT COUNT(*) AS total_rules, ROUND(AVG(precision), 12) AS average_precision, "
    f"COALESCE({msum('captured_fraud_amount')}, 0.0) AS total_captured_fraud_amount, "
    "CAST(COALESCE(SUM(num_transactions), 0) AS BIGINT) AS total_transactions, "
    "CAST(COALESCE(SUM(num_frauds), 0) AS BIGINT) AS total_frauds FROM sel"
)
COMBINED = "SELECT string_agg('(' || rule_string || ')', ' OR ' ORDER BY rank) AS combined_rule FROM sel"
HITS = (
    "SELECT b.* FROM band b WHERE EXISTS (SELECT 1 FROM sel r WHERE r.amount_bucket = b.amount_bucket "
    "AND r.card_profile_dep = b.card_profile_dep AND b.cs >= r.score_lo AND b.cs < r.score_hi)"
)
COND_ROWS = (
    "SELECT amount_bucket, cs, card_profile_dep, 'cs' AS feature, 'range' AS op, CAST(NULL AS VARCHAR) AS value, "
    "score_lo AS lo, score_hi AS hi FROM r "
    "UNION ALL SELECT amount_bucket, cs, card_profile_dep, 'card_profile_dep', '=', card_profile_dep, "
    "CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM r"
)


# ---- rules over all subsets of four mining columns ------------------------------------------

LATTICE = ("cs", "card_profile_dep", "part_id", "ship_address_usage_ind")


def lattice_ctes() -> tuple[str, ...]:
    cols = ", ".join(LATTICE)
    sets = ", ".join(
        "(" + ", ".join(["amount_bucket", *[f for i, f in enumerate(LATTICE) if m >> i & 1]]) + ")" for m in range(1, 1 << len(LATTICE))
    )
    bound = " AND ".join(f"(GROUPING({f}) = 1 OR {f} IS NOT NULL)" for f in LATTICE)
    size = " + ".join(f"CASE WHEN {f} IS NULL THEN 0 ELSE 1 END" for f in LATTICE)
    lat = (
        f"lat AS (SELECT *, {size} AS n_bound FROM (SELECT amount_bucket, {cols}, COUNT(*) AS support FROM "
        "(SELECT amount_bucket, ROUND(cs, 1) AS cs, card_profile_dep, part_id, ship_address_usage_ind FROM band "
        "WHERE cs >= 0.35 AND amount_bucket IS NOT NULL) "
        f"GROUP BY GROUPING SETS ({sets}) HAVING COUNT(*) >= 50 AND {bound}))"
    )
    extends = " AND ".join(f"(p.{f} IS NULL OR q.{f} = p.{f})" for f in LATTICE)
    pat = (
        f"pat AS (SELECT amount_bucket, {cols}, support FROM lat p WHERE NOT EXISTS (SELECT 1 FROM lat q "
        f"WHERE q.amount_bucket = p.amount_bucket AND q.n_bound > p.n_bound AND {extends}))"
    )
    rul = (
        "r AS (SELECT *, CASE WHEN cs IS NOT NULL THEN ROUND(GREATEST(0.0, cs - 0.05), 3) END AS score_lo, "
        "CASE WHEN cs IS NOT NULL THEN ROUND(LEAST(1.0, cs + 0.05), 3) END AS score_hi FROM pat)"
    )
    hit = (
        "b.amount_bucket = r.amount_bucket AND (r.cs IS NULL OR (b.cs >= r.score_lo AND b.cs < r.score_hi)) AND "
        + " AND ".join(f"(r.{f} IS NULL OR b.{f} = r.{f})" for f in LATTICE[1:])
    )
    keys = f"r.amount_bucket, {', '.join('r.' + f for f in LATTICE)}, r.support, r.score_lo, r.score_hi"
    ev = (
        f"ev AS (SELECT {keys}, COUNT(b.amount_bucket) AS num_transactions, "
        "CAST(COALESCE(SUM(CAST(b.is_fraud AS INTEGER)), 0) AS BIGINT) AS num_frauds, "
        f"COALESCE(CAST(SUM(CAST(CASE WHEN b.is_fraud = 1 THEN b.amount ELSE 0 END AS {MONEY})) AS DOUBLE), 0.0) AS captured_fraud_amount "
        f"FROM r LEFT JOIN band b ON {hit} GROUP BY {keys})"
    )
    quote = "''''"
    text = (
        f"({AMOUNT_TEXT}) || COALESCE(' AND event.cs >= ' || printf('%.3f', score_lo) || ' AND event.cs < ' || printf('%.3f', score_hi), '') "
        f"|| COALESCE(' AND event.card_profile_dep = ' || {quote} || card_profile_dep || {quote}, '') "
        "|| COALESCE(' AND event.part_id = ' || part_id, '') "
        f"|| COALESCE(' AND event.ship_address_usage_ind = ' || {quote} || ship_address_usage_ind || {quote}, '')"
    )
    order = ", ".join(["amount_recall DESC", "amount_bucket ASC", *[f"{f} ASC NULLS FIRST" for f in LATTICE]])
    ranked = f"rk AS (SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY {order}) AS INTEGER) AS rank, {text} AS rule_string FROM k)"
    return BAND, lat, pat, rul, ev, TOTAL, MET, KEPT, ranked, hit


def lattice_queries() -> dict[str, str]:
    *ctes, hit = lattice_ctes()
    cols = ", ".join(LATTICE)
    shown = f"rank, amount_bucket, {cols}, rule_string, support, num_transactions, num_frauds, captured_fraud_amount, precision, amount_recall"
    return {
        "mine_lattice": with_(*ctes[:2]) + f"SELECT amount_bucket, {cols}, support FROM lat",
        "lattice_rules": with_(*ctes) + f"SELECT {shown} FROM rk",
        "lattice_hits": with_(*ctes) + f"SELECT b.* FROM band b WHERE EXISTS (SELECT 1 FROM rk r WHERE r.rank <= 8 AND {hit})",
    }


# ---- rules with wildcards: NULL and -1 in the mining columns ----------------------------------

NULL_BAND = (
    "bn AS (SELECT is_fraud, amount, amount_bucket, CASE WHEN bill_count % 11 <> 0 THEN cs END AS cs, "
    "CASE WHEN bill_count % 7 <> 0 THEN card_profile_dep END AS card_profile_dep, "
    "CAST(bill_count % 3 - 1 AS INTEGER) AS n FROM band)"
)


def null_queries() -> dict[str, str]:
    cols = "amount_bucket, cs, card_profile_dep, n"
    pat = (
        "pat AS (SELECT amount_bucket, ROUND(cs, 1) AS cs, card_profile_dep, n, COUNT(*) AS support FROM bn "
        "WHERE is_fraud = 1 AND amount_bucket IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING COUNT(*) >= 5)"
    )
    rul = (
        "r AS (SELECT *, CASE WHEN cs IS NOT NULL THEN ROUND(GREATEST(0.0, cs - 0.05), 3) END AS score_lo, "
        "CASE WHEN cs IS NOT NULL THEN ROUND(LEAST(1.0, cs + 0.05), 3) END AS score_hi FROM pat)"
    )
    keys = "r.amount_bucket, r.cs, r.card_profile_dep, r.n, r.support, r.score_lo, r.score_hi"
    ev = (
        f"ev AS (SELECT {keys}, COUNT(b.amount_bucket) AS num_transactions, "
        "CAST(COALESCE(SUM(CAST(b.is_fraud AS INTEGER)), 0) AS BIGINT) AS num_frauds, "
        f"COALESCE(CAST(SUM(CAST(CASE WHEN b.is_fraud = 1 THEN b.amount ELSE 0 END AS {MONEY})) AS DOUBLE), 0.0) AS captured_fraud_amount "
        "FROM r LEFT JOIN bn b ON b.amount_bucket = r.amount_bucket AND (r.cs IS NULL OR (b.cs >= r.score_lo AND b.cs < r.score_hi)) "
        "AND (r.card_profile_dep IS NULL OR b.card_profile_dep = r.card_profile_dep) AND (r.n IS NULL OR r.n = -1 OR b.n = r.n) "
        f"GROUP BY {keys})"
    )
    quote = "''''"
    text = (
        f"({AMOUNT_TEXT}) || COALESCE(' AND event.cs >= ' || printf('%.3f', score_lo) || ' AND event.cs < ' || printf('%.3f', score_hi), '') "
        f"|| COALESCE(' AND event.card_profile_dep = ' || {quote} || card_profile_dep || {quote}, '') "
        "|| CASE WHEN n IS NULL OR n = -1 THEN '' ELSE ' AND event.n = ' || n END"
    )
    shown = f"{cols}, {text} AS rule_string, support, num_transactions, num_frauds, captured_fraud_amount, precision, amount_recall"
    return {
        "null_rules": with_(BAND, NULL_BAND, pat, rul, ev, TOTAL, MET) + f"SELECT {shown} FROM m",
        "null_view_sentinel": with_(BAND, NULL_BAND)
        + "SELECT is_fraud, amount, amount_bucket, COALESCE(cs, -1) AS cs, card_profile_dep, n FROM bn",
    }


# ---- sources and sinks, a tree as a table ----------------------------------------------------

RAW = (
    "raw AS (SELECT CASE WHEN bill_count % 17 <> 0 THEN mch_id_trimmed END AS m, "
    "CASE WHEN bill_count % 13 = 0 THEN 'n/a' WHEN bill_count % 19 <> 0 THEN CAST(amount AS VARCHAR) END AS a, "
    "CASE WHEN bill_count = 41 THEN 3000000000 ELSE CAST(is_fraud AS BIGINT) END AS f, "
    "CASE WHEN bill_count % 11 <> 0 THEN cs END AS c, "
    "CASE WHEN bill_count % 10 = 3 THEN bill_count + 0.5::DOUBLE WHEN bill_count % 10 <> 7 THEN CAST(bill_count AS DOUBLE) END AS b, "
    "card_profile_dep, issuer_member FROM tx)"
)
REASONS = (
    "why AS (SELECT *, CASE WHEN m IS NULL THEN 'mch_id_trimmed:null' END AS r1, "
    "CASE WHEN a IS NULL THEN 'amount:null' WHEN TRY_CAST(a AS DOUBLE) IS NULL THEN 'amount:type' END AS r2, "
    "CASE WHEN TRY_CAST(f AS INTEGER) IS NULL THEN 'is_fraud:type' END AS r3, "
    "CASE WHEN b <> floor(b) THEN 'bill_count:lossy' END AS r4 FROM raw)"
)


def source_queries() -> dict[str, str]:
    good = "r1 IS NULL AND r2 IS NULL AND r3 IS NULL AND r4 IS NULL"
    one = " UNION ALL ".join(f"SELECT {r} AS w FROM why WHERE {r} IS NOT NULL" for r in ("r1", "r2", "r3", "r4"))
    return {
        "schema_rows": with_(RAW, REASONS)
        + "SELECT m AS mch_id_trimmed, TRY_CAST(a AS DOUBLE) AS amount, TRY_CAST(f AS INTEGER) AS is_fraud, c AS cs, "
        f"CAST(b AS INTEGER) AS bill_count, card_profile_dep, CAST(NULL AS VARCHAR) AS auth_note FROM why WHERE {good}",
        "schema_rejected": with_(RAW, REASONS)
        + "SELECT card_profile_dep, CAST(issuer_member AS VARCHAR) AS issuer_member, concat_ws(',', r1, r2, r3, r4) AS reasons "
        f"FROM why WHERE NOT ({good})",
        "schema_report": with_(RAW, REASONS)
        + f"SELECT split_part(w, ':', 1) AS \"column\", split_part(w, ':', 2) AS reason, COUNT(*) AS n FROM ({one}) GROUP BY 1, 2",
        "published_rules": with_(*RULE_CTES)
        + f"SELECT rank, rule_string, {METRICS}, CAST(2 AS BIGINT) AS version, (SELECT COUNT(*) FROM k) AS rules_before FROM sel",
    }


def sketch_queries() -> dict[str, str]:
    one = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, COUNT(DISTINCT {c}) + MAX(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n_distinct, "
        "COUNT(*) AS n, TRUE AS within_error FROM events"
        for c in ("event_id", "user_id", "event_type")
    )
    return {
        "sketch_cardinality": f"SELECT feature, CAST(n_distinct AS BIGINT) AS n_distinct, n, within_error FROM ({one})",
        "sketch_quantiles": "SELECT CAST(s AS DOUBLE) AS share, n, TRUE AS within_error FROM (VALUES (0.0), (0.5), (0.9), (0.95), (1.0)) t(s), "
        "(SELECT COUNT(*) AS n FROM events WHERE value IS NOT NULL AND NOT isnan(value))",
    }


def tree_queries() -> dict[str, str]:
    rows = (
        "t AS (SELECT mch_id_trimmed, amount, is_fraud, CASE WHEN bill_count % 11 <> 0 THEN cs END AS cs, "
        "CASE WHEN bill_count % 5 <> 0 THEN bill_count END AS n, "
        'CASE WHEN bill_count % 7 <> 0 THEN issuer_bin_profile_issuing_cou <> merchant_country_code END AS "cross" FROM band)'
    )
    leaf = (
        "l AS (SELECT *, CAST(CASE WHEN cs <= 0.35 THEN CASE WHEN \"cross\" THEN 5 ELSE 4 END "
        "WHEN cs <= 0.65 THEN CASE WHEN n <= 24.5 THEN 12 ELSE 13 END ELSE 7 END AS BIGINT) AS leaf_id FROM t)"
    )
    shown = (
        "SELECT *, CASE WHEN leaf_id IN (7, 13) THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction, CASE leaf_id WHEN 4 THEN 0.05 "
        "WHEN 5 THEN 0.2 WHEN 7 THEN 0.95 WHEN 12 THEN 0.45 WHEN 13 THEN 0.72 END::DOUBLE AS fraud_probability FROM l"
    )
    zero = "CAST(0 AS BIGINT) AS"
    return {
        "tree_rows": with_(BAND, rows, leaf) + shown,
        "tree_positive_rows": with_(BAND, rows, leaf) + f"SELECT * FROM ({shown}) WHERE leaf_id IN (7, 13)",
        "tree_agreement": with_(BAND)
        + f"SELECT COUNT(*) AS rows, {zero} predictions_differ, {zero} probabilities_differ, {zero} flags_differ FROM band",
    }


def oracle() -> dict[str, str]:
    q: dict[str, str] = {
        "tx_scan": with_() + "SELECT * FROM tx",
        "merchant_profile": q_profile("mch_id_trimmed"),
        "issuer_profile": q_profile("issuer_member"),
        "id_profile": q_profile("part_id"),
        "attach_merchant_profile": q_attach("mch_id_trimmed"),
        "attach_issuer_profile": q_attach("issuer_member"),
        "attach_id_profile": q_attach("part_id"),
        "attach_issuer_profile_salted": q_attach("issuer_member"),
        "attach_merchant_without_self": q_without_self("mch_id_trimmed"),
        "attach_issuer_without_self": q_without_self("issuer_member"),
        "risk_bins": q_risk_bins(),
        "risk_tier_merchant": q_tier("mch_id_trimmed"),
        "risk_tier_issuer": q_tier("issuer_member"),
        "risk_tier_id": q_tier("part_id"),
        "tier_onehot": q_tier_onehot(),
        "cardinality": q_cardinality(),
        "freq_table": with_() + FREQ,
        "freq_encode": with_(f"f AS ({FREQ})") + "SELECT tx.*, f.part_id_freq FROM tx LEFT JOIN f ON tx.part_id = f.part_id",
        "onehot_encode": q_onehot(),
        "amount_flags": with_(f"a AS (SELECT amount, is_fraud, {BUCKET_SQL} AS amount_bucket FROM tx)")
        + f"SELECT amount, is_fraud, amount_bucket, {RANGES} FROM a",
        "amount_bucket_counts": with_() + f"SELECT {BUCKET_SQL} AS amount_bucket, COUNT(*) AS n FROM tx GROUP BY 1",
        "score_band": with_() + "SELECT * FROM tx WHERE fraud_score >= 50 AND fraud_score < 70",
        "cross_border_flag": with_()
        + "SELECT *, CASE WHEN issuer_bin_profile_issuing_cou <> merchant_country_code THEN 1 ELSE 0 END AS is_cross_border FROM tx",
        "mine_patterns": with_(BAND, PAT) + "SELECT * FROM pat",
        "rule_text": with_(BAND, PAT, RUL) + f"SELECT amount_bucket, cs, card_profile_dep, support, {RULE_TEXT} AS rule_string FROM r",
        "rule_conditions": with_(BAND, PAT, RUL) + COND_ROWS,
        "rule_eval": with_(*RULE_CTES[:6]) + f"SELECT {METRICS} FROM m",
        "rules_kept": with_(*RULE_CTES[:7]) + f"SELECT {METRICS} FROM k",
        "fraud_amount_total": with_(BAND, TOTAL) + "SELECT * FROM tot",
        "rules_ranked": with_(*RULE_CTES[:8]) + "SELECT rank, amount_bucket, cs, card_profile_dep, amount_recall FROM rk",
        "extract_rules": with_(*RULE_CTES[:8]) + f"SELECT rank, rule_string, {METRICS} FROM rk",
        "top_rules": with_(*RULE_CTES) + "SELECT rank, amount_bucket, cs, card_profile_dep, amount_recall FROM sel",
        "ruleset_rules": with_(*RULE_CTES)
        + f"SELECT rank, amount_lo, amount_hi, score_lo, score_hi, rule_string, {METRICS} FROM sel",
        "ruleset_metrics": with_(*RULE_CTES) + RS_METRICS,
        "combined_rule": with_(*RULE_CTES) + COMBINED,
        "ruleset": with_(*RULE_CTES) + f"SELECT * FROM ({COMBINED}) c, ({RS_METRICS}) s",
        "ruleset_hits": with_(*RULE_CTES) + HITS,
        "ruleset_union_metrics": with_(*RULE_CTES, TOTAL.replace("tot AS", "tot2 AS"))
        + "SELECT COUNT(*) AS union_transactions, CAST(COALESCE(SUM(CAST(is_fraud AS INTEGER)), 0) AS BIGINT) AS union_frauds, "
        f"COALESCE({msum(FRAUD_AMT)}, 0.0) AS union_captured_fraud_amount, "
        "CASE WHEN COUNT(*) > 0 THEN COALESCE(SUM(CAST(is_fraud AS INTEGER)), 0) / COUNT(*) ELSE 0.0 END AS union_precision, "
        f"CASE WHEN MAX(tot2.total_fraud_amount) > 0 THEN COALESCE({msum(FRAUD_AMT)}, 0.0) / MAX(tot2.total_fraud_amount) ELSE 0.0 END AS union_amount_recall "
        f"FROM ({HITS}) h, tot2",
    }
    # null sentinel: band rows + merchant profile, numeric NULLs -> -1
    body, names = profile_sql("mch_id_trimmed", "merchant")
    numeric_tx = {"mch_id_trimmed", "issuer_member", "part_id", "amount", "is_fraud", "fraud_score", "cs", "bill_count"}
    cols = [f"COALESCE(b.{c}, -1) AS {c}" if c in numeric_tx else f"b.{c}" for c in TX_COLS]
    cols += [f"COALESCE(p.{c}, -1) AS {c}" for c in names]
    q["null_sentinel"] = with_(f"p AS ({body})") + (
        f"SELECT {', '.join(cols)} FROM (SELECT * FROM tx WHERE fraud_score >= 50 AND fraud_score < 70) b "
        "LEFT JOIN p ON b.mch_id_trimmed = p.mch_id_trimmed"
    )
    return {**q, **lattice_queries(), **null_queries(), **source_queries(), **sketch_queries(), **tree_queries(), **slot_queries()}
