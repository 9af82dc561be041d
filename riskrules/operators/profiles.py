"""Entity risk profiles (A1-A11, P6) and their attachment to rows.

All measures of one entity come from ONE aggregate over ONE scan: the
small/large/auth/3-D Secure/cross-border rates are conditional means, which
after the left join equal the separately filtered group-bys they replace.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import label_double, money_less, money_parts, money_sum, safe_ratio, tier_expr
from ..functions.joins import VALUE_BYTES, Budget, attach, fixed_width, text_bytes
from ..roles import Params, Roles

CROSS_BORDER = "is_cross_border"
#: Bytes of the text of a whole number, at most.
NUMBER_TEXT = 20
#: Column of a profile that holds the tier edges, beside the states.
BINS = "__bins"


def profile_kind(key: str, roles: Roles) -> str:
    if key == roles.merchant:
        return "merchant"
    if key == roles.issuer:
        return "issuer"
    return "generic"


def measure_names(key: str, roles: Roles) -> dict[str, str]:
    """Output column names of a profile by measure."""
    kind = profile_kind(key, roles)
    if kind == "generic":
        p = key
        return {
            "rate": f"{p}_fraud_rate",
            "count": f"{p}_tx_count",
            "avg": f"{p}_avg_amount",
            "std": f"{p}_std_amount",
            "amount_rate": f"{p}_fraud_amount_rate",
        }
    p = kind
    names = {
        "rate": f"{p}_fraud_rate",
        "count": f"{p}_tx_count",
        "avg": f"{p}_avg_amount",
        "std": f"{p}_amount_std",
        "amount_rate": f"{p}_fraud_amount_rate",
    }
    if kind == "merchant":
        names["small"] = "merchant_small_amount_fraud_rate"
        names["large"] = "merchant_large_amount_fraud_rate"
    else:
        names["auth"] = "issuer_auth_rate"
        names["3ds"] = "issuer_3ds_usage_rate"
        names["xb"] = "issuer_cross_border_rate"
        names["xb_fraud"] = "issuer_cross_border_fraud_rate"
    return names


def has_cross_border(df: DataFrame, roles: Roles) -> bool:
    return roles.issuing_country in df.columns and roles.merchant_country in df.columns


def cross_border_flag(roles: Roles) -> Column:
    """1 when issuing and merchant country differ; NULL on either side gives 0."""
    return (
        F.when(F.col(roles.issuing_country) != F.col(roles.merchant_country), 1)
        .otherwise(0)
        .alias(CROSS_BORDER)
    )


def with_cross_border(df: DataFrame, roles: Roles) -> DataFrame:
    if not has_cross_border(df, roles) or CROSS_BORDER in df.columns:
        return df
    return df.withColumn(CROSS_BORDER, cross_border_flag(roles))


#: Prefix of the additive states from which a row's own share can be taken off.
STATE = "__state_"


def _label_rates(columns, roles: Roles, params: Params, xb: Column | None = None) -> dict[str, Column]:
    """What each rate that holds the label averages: the label, where it counts."""
    y, amt, t = label_double(roles.label), F.col(roles.amount), params.amount_thresholds
    out = {"rate": y, "small": F.when(amt <= F.lit(float(t[0])), y), "large": F.when(amt > F.lit(float(t[-1])), y)}
    if roles.issuing_country in columns and roles.merchant_country in columns:
        out["xb_fraud"] = F.when((cross_border_flag(roles) if xb is None else xb) == 1, y)
    return out


def _positive_amount(roles: Roles) -> Column:
    return F.when(F.col(roles.label) == 1, F.col(roles.amount)).otherwise(F.lit(0.0))


def label_states(df: DataFrame, roles: Roles, params: Params, xb: Column | None = None) -> list[Column]:
    """Additive states of every measure that holds the label: sums and counts, and
    exact sums of money.  ``xb``: the cross-border flag, if it is a column."""
    out = []
    for name, y in _label_rates(df.columns, roles, params, xb).items():
        out += [F.sum(y).alias(f"{STATE}{name}_sum"), F.count(y).alias(f"{STATE}{name}_n")]
    return [*out, *money_parts(_positive_amount(roles), f"{STATE}positive"), *money_parts(roles.amount, f"{STATE}amount")]


def less_own_label(rows: DataFrame, key: str, roles: Roles, params: Params, bins: str | None = None) -> DataFrame:
    """Rows with an attached profile and its states: every measure that holds the label
    is learned from the OTHER rows of the entity, and the states are dropped.

    A row's profile then tells nothing about its own label.  Counts, mean amount,
    deviation and the rates without the label stay those of all rows.  NULL where no
    other row counts, and for a NULL key.  ``bins``: a column of tier edges; the tier is
    then that of the row's own new rate.  The rows have to be rows of the population.
    """
    names = measure_names(key, roles)
    made = {}
    for name, y in _label_rates(rows.columns, roles, params).items():
        if names.get(name) in rows.columns:
            left = F.coalesce(F.col(f"{STATE}{name}_sum"), F.lit(0.0)) - F.coalesce(y, F.lit(0.0))
            made[names[name]] = safe_ratio(left, F.col(f"{STATE}{name}_n") - y.isNotNull().cast("long"))
    made[names["amount_rate"]] = safe_ratio(
        money_less(f"{STATE}positive", _positive_amount(roles)), money_less(f"{STATE}amount", roles.amount)
    )
    tier = names["rate"].replace("_fraud_rate", "_risk_tier")
    out = rows.withColumns(made)
    if bins is not None:
        # rows without a profile keep their NULL tier
        out = out.withColumn(tier, F.when(F.col(bins).isNotNull(), tier_expr(F.col(names["rate"]), F.col(bins)))).drop(bins)
    return out.drop(*[c for c in out.columns if c.startswith(STATE)])


def entity_profile(df: DataFrame, key: str, roles: Roles, params: Params, *, states: bool = False) -> DataFrame:
    """One row per value of ``key`` (NULL is a group of its own); ``states`` adds what
    ``less_own_label`` needs."""
    names = measure_names(key, roles)
    y = label_double(roles.label)
    amt = F.col(roles.amount)
    fraud_amt = F.when(F.col(roles.label) == 1, amt).otherwise(F.lit(0.0))
    aggs = [
        F.avg(y).alias(names["rate"]),
        F.count(F.lit(1)).alias(names["count"]),
        safe_ratio(money_sum(amt), F.count(amt)).alias(names["avg"]),
        F.stddev_samp(amt).alias(names["std"]),
        safe_ratio(money_sum(fraud_amt), money_sum(amt)).alias(names["amount_rate"]),
    ]
    kind = profile_kind(key, roles)
    if kind == "merchant":
        t = params.amount_thresholds
        aggs.append(F.avg(F.when(amt <= F.lit(float(t[0])), y)).alias(names["small"]))
        aggs.append(F.avg(F.when(amt > F.lit(float(t[-1])), y)).alias(names["large"]))
    elif kind == "issuer":
        if roles.status in df.columns:
            aggs.append(
                F.avg(F.when(F.col(roles.status) == "Y", 1.0).otherwise(0.0)).alias(names["auth"])
            )
        if roles.auth_mode in df.columns:
            aggs.append(
                F.avg(F.when(F.col(roles.auth_mode) != "N", 1.0).otherwise(0.0)).alias(names["3ds"])
            )
        if has_cross_border(df, roles):
            xb = cross_border_flag(roles)
            aggs.append(F.avg(xb.cast("double")).alias(names["xb"]))
            aggs.append(F.avg(F.when(xb == 1, y)).alias(names["xb_fraud"]))
    if states:
        aggs += label_states(df, roles, params)
    return df.groupBy(key).agg(*aggs)


def entity_rates(df: DataFrame, keys: Sequence[str], roles: Roles) -> DataFrame:
    """``entity int, rate double``: A1 of every value of every key (NULL is a group of its
    own) from one aggregate over one scan; ``entity`` is the key's place in ``keys``."""
    n = len(keys)
    agg = df.groupingSets([[F.col(k)] for k in keys], *[F.col(k) for k in keys]).agg(
        F.avg(label_double(roles.label)).alias("rate"), F.grouping_id().alias("__gid")
    )
    # a set's grouping id has every bit but its key's
    entity = F.coalesce(*[F.when(F.col("__gid") == F.lit((2**n - 1) - 2 ** (n - 1 - i)), F.lit(i)) for i in range(n)])
    return agg.select(entity.alias("entity"), "rate")


def profile_columns(profile: DataFrame, key: str) -> list[str]:
    return [c for c in profile.columns if c != key]


def attach_profile(
    rows: DataFrame,
    profile: DataFrame,
    key: str,
    roles: Roles,
    params: Params,
    *,
    keyed_size: tuple[int, int] | None = None,
    budget: Budget | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Left join of a profile on ``key``; NULL keys never match (NULL measures).  A
    profile with states is attached without the row's own label (``less_own_label``)."""
    count_col = measure_names(key, roles)["count"]
    out = attach(rows, profile, key, params, count_col=count_col, keyed_size=keyed_size, budget=budget, partitions=partitions)
    if f"{STATE}rate_n" in profile.columns:
        return less_own_label(out, key, roles, params, BINS if BINS in profile.columns else None)
    return out


# ---- one pass for every profile and every category count -----------------------------


def _all_measures(df: DataFrame, roles: Roles, params: Params, xb: Column) -> list[Column]:
    """Every measure any profile kind needs, under internal names; ``xb`` is the cross-border flag."""
    y = label_double(roles.label)
    amt = F.col(roles.amount)
    fraud_amt = F.when(F.col(roles.label) == 1, amt).otherwise(F.lit(0.0))
    t = params.amount_thresholds
    out = [
        F.avg(y).alias("__rate"),
        F.count(F.lit(1)).alias("__count"),
        safe_ratio(money_sum(amt), F.count(amt)).alias("__avg"),
        F.stddev_samp(amt).alias("__std"),
        safe_ratio(money_sum(fraud_amt), money_sum(amt)).alias("__amount_rate"),
        F.avg(F.when(amt <= F.lit(float(t[0])), y)).alias("__small"),
        F.avg(F.when(amt > F.lit(float(t[-1])), y)).alias("__large"),
    ]
    if roles.status in df.columns:
        out.append(F.avg(F.when(F.col(roles.status) == "Y", 1.0).otherwise(0.0)).alias("__auth"))
    if roles.auth_mode in df.columns:
        out.append(F.avg(F.when(F.col(roles.auth_mode) != "N", 1.0).otherwise(0.0)).alias("__3ds"))
    if has_cross_border(df, roles):
        out.append(F.avg(xb.cast("double")).alias("__xb"))
        out.append(F.avg(F.when(xb == 1, y)).alias("__xb_fraud"))
    return out


class PopulationStats:
    """Profiles of all id columns from one aggregate over the population, and value
    counts of all other categoricals from a second one, each checkpointed.

    An id seldom repeats among the rows of one task, so partial rows of 25 buffers would be
    shuffled where rows of three numbers do: every row is dealt once per id, by it, with
    what that id's measures read, and is aggregated there.  Spark splits what a frequent id
    makes large (``rebalance``), so a partial row per task and id follows, as short as the
    list of ids.  Values of categoricals repeat: ``GROUPING SETS``, partially aggregated
    before the shuffle.

    ``profile(key)`` equals ``entity_profile(df, key)``; ``counts`` equals
    ``encode.category_counts(df, categoricals)``.
    """

    def __init__(self, df: DataFrame, roles: Roles, params: Params, categoricals=()):
        from ..functions.exprs import category_text

        self.roles, self.params = roles, params
        self.ids = list(roles.ids)
        self.cats = list(categoricals)
        # a whole number and its text are one to one: such an id's own set counts the category too
        whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
        self.by_id = {f for f in self.cats if f in self.ids and isinstance(df.schema[f].dataType, whole)}
        self.cat_col = {f: f if f in self.by_id else f"__cat_{i}" for i, f in enumerate(self.cats)}
        texts = [f for f in self.cats if f not in self.by_id]
        base = df.select("*", *[category_text(f).alias(self.cat_col[f]) for f in texts])
        cols = self.ids + [self.cat_col[f] for f in texts]
        if not cols:
            raise ValueError("PopulationStats needs at least one id or categorical column")
        # the number of a column's set
        self.gid = {c: i for i, c in enumerate(cols)}
        # one row per distinct key of every set, always checkpointed (small):
        # the band query reads it beside its own scan of the same input, and
        # the analyzer's re-instantiation of shared leaves makes a cached plan
        # miss there; a checkpointed relation is read back, never recomputed.
        from ..functions.joins import checkpoint

        made = [checkpoint(agg) for agg in (self._by_id(df), self._by_value(base, [self.cat_col[f] for f in texts])) if agg is not None]
        self.table = made[0] if len(made) == 1 else made[0].unionByName(made[1], allowMissingColumns=True)
        self.has = set(self.table.columns)
        self._groups: dict[int, tuple[int, int, int]] | None = None

    def _by_id(self, df: DataFrame) -> DataFrame | None:
        """The measures of every id's values, ``__gid`` telling the id."""
        if not self.ids:
            return None
        roles, gid = self.roles, F.col("__gid")
        xb = F.col("__xb_flag")
        flag = [cross_border_flag(roles).alias("__xb_flag")] if has_cross_border(df, roles) else []
        rows = df.select("*", *flag, F.explode(F.array(*[F.lit(self.gid[k]) for k in self.ids])).alias("__gid"))
        # the key of one set, and what its measures read
        keys = {f"__key_{i}": F.when(gid == F.lit(self.gid[k]), F.col(k)) for i, k in enumerate(self.ids)}
        of_issuer = gid == F.lit(self.gid[roles.issuer]) if roles.issuer in self.ids else F.lit(False)
        read = dict.fromkeys((roles.label, roles.amount))
        only = [c for c in (roles.status, roles.auth_mode) if c in df.columns and c not in read] + ["__xb_flag"] * len(flag)
        dealt = rows.select(gid, *[k.alias(c) for c, k in keys.items()], *read, *[F.when(of_issuer, F.col(c)).alias(c) for c in only])
        # by the label too: were an id's rows all in one partition, Spark would not split it
        dealt = dealt.hint("rebalance", "__gid", *keys, roles.label)
        measures = _all_measures(df, roles, self.params, xb)
        if not self.params.own_label:
            measures += label_states(df, roles, self.params, xb)
        return dealt.groupBy("__gid", *keys).agg(*measures).withColumnsRenamed(dict(zip(keys, self.ids)))

    def _by_value(self, base: DataFrame, cols: Sequence[str]) -> DataFrame | None:
        """Rows of every value of the columns."""
        if not cols:
            return None
        n = len(cols)
        agg = base.groupingSets([[F.col(c)] for c in cols], *[F.col(c) for c in cols]).agg(
            F.count(F.lit(1)).alias("__count"), F.grouping_id().alias("__set")
        )
        # a set's grouping id has every bit but its column's
        gid = F.coalesce(*[F.when(F.col("__set") == F.lit((2**n - 1) - 2 ** (n - 1 - i)), F.lit(self.gid[c])) for i, c in enumerate(cols)])
        return agg.select(gid.alias("__gid"), *cols, "__count")

    def profile(self, key: str, table: DataFrame | None = None, extra=()) -> DataFrame:
        """One id's profile (its grouping set), from the aggregate or from a
        table derived from it (``extra``: further columns to keep)."""
        names = measure_names(key, self.roles)
        sel = [F.col(key)]
        for m, out in names.items():
            src = f"__{m}"
            if src in self.has:
                sel.append(F.col(src).alias(out))
        sel += [F.col(c) for c in self.table.columns if c.startswith(STATE)]
        t = self.table if table is None else table
        return t.where(F.col("__gid") == F.lit(self.gid[key])).select(*sel, *extra)

    def key_is_null(self) -> Column:
        """True on the NULL-key group of whichever id set a row belongs to."""
        expr = None
        for k in self.ids:
            cond = F.col("__gid") == F.lit(self.gid[k])
            expr = F.when(cond, F.col(k).isNull()) if expr is None else expr.when(cond, F.col(k).isNull())
        return expr if expr is not None else F.lit(False)

    @property
    def counts(self) -> DataFrame:
        """``feature, value, n`` of every categorical: one filter and CASE
        projections over the cached aggregate (a union of per-feature filters
        would re-instantiate the plan and miss the cache)."""
        gids = [self.gid[self.cat_col[f]] for f in self.cats]
        feature = value = None
        for f in self.cats:
            cond = F.col("__gid") == F.lit(self.gid[self.cat_col[f]])
            feature = F.when(cond, F.lit(f)) if feature is None else feature.when(cond, F.lit(f))
            col = F.col(self.cat_col[f]).cast("string")
            value = F.when(cond, col) if value is None else value.when(cond, col)
        return self.table.where(F.col("__gid").isin(gids)).select(
            feature.alias("feature"), value.alias("value"), F.col("__count").alias("n")
        )

    def cardinalities(self) -> dict[str, int]:
        """Distinct values (NULL counted once) of every id and categorical, in
        one small job: the number of groups in each grouping set."""
        groups = self._sizes()
        names = {**{k: k for k in self.ids}, **self.cat_col}
        return {f: groups.get(self.gid[c], (0, 0, 0))[0] for f, c in names.items()}

    def rows(self) -> int:
        """Rows of the population: every grouping set counts all of them."""
        return max((n for _, _, n in self._sizes().values()), default=0)

    def _sizes(self) -> dict[int, tuple[int, int, int]]:
        """Number of groups, bytes of the key texts and rows of every grouping set (one job)."""
        if self._groups is None:
            # the columns of other sets are NULL, so a row's texts are those of its key
            texts = F.sum(text_bytes(self.table.schema.fields))
            agg = self.table.groupBy("__gid").agg(F.count(F.lit(1)).alias("n"), texts.alias("texts"), F.sum("__count").alias("rows"))
            self._groups = {r["__gid"]: (r["n"], int(r["texts"]), int(r["rows"])) for r in agg.collect()}
        return self._groups

    def size(self, name: str, keyed: DataFrame, *, categorical: bool = False) -> tuple[int, int]:
        """Rows and bytes of a table ``keyed`` by an id, or by a categorical (a column can be
        both).  Texts besides the key (the tier) are short labels, counted with a value's
        bytes more each."""
        n, texts, _ = self._sizes().get(self.gid[self.cat_col[name] if categorical else name], (0, 0, 0))
        if categorical and name in self.by_id:
            texts = n * NUMBER_TEXT
        short = sum(VALUE_BYTES for f in keyed.schema.fields if isinstance(f.dataType, T.StringType))
        return n, n * (fixed_width(keyed.schema.fields) + short) + texts

    def unpersist(self) -> None:
        self.table.unpersist()
