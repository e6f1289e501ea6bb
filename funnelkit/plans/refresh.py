"""Refresh of a written mart by changed keys.

A change of a role touches the applications whose rows join the changed keys, directly or through a chain
(metro -> postal code -> address -> application, run -> application, card event -> decision, person ->
user). The keys are carried back to the two stages, only the touched applications go through the mart's joins,
and their rows replace the old ones. Row identity is the pair (late_id, early_id) of ``keyed_mart``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit.plans.mart import enriched_spine, mart_columns, signals_from_states, underwriting_signals
from funnelkit.plans.params import MartParams
from funnelkit.sources.shared import written

ROW_KEY = ("late_id", "early_id")

#: Column that names the changed rows of each role. The stages are named by application and need their
#: prequal ids too, as they were and as they are.
CHANGE_KEYS = {
    "checkout_funnel": "application_id", "prequal_funnel": "application_id", "prequal": "prequal_id",
    "prequal_decision": "guarantee_id", "card_state_event": "user_id", "decision_log": "charge_id",
    "app_run_bridge": "application_id", "decision_run": "run_id", "merchant_dim": "merchant_id", "risky_merchant": "merchant_id",
    "merchant_segment": "merchant_id", "checkout_session": "checkout_id", "checkout_mart": "checkout_id", "purchases": "checkout_id",
    "offered_terms": "checkout_id", "charge_mart": "charge_id", "bad_outcome": "charge_id", "user_dim": "user_id",
    "person_stats": "person_id", "application": "application_id", "address": "address_id", "postal_metro": "postal_code",
    "risky_metro": "metro",
}
#: Roles that are joined by one id of a stage.
DIRECT = {
    "checkout": ("checkout_session", "checkout_mart", "purchases", "offered_terms"),
    "charge": ("charge_mart", "decision_log", "bad_outcome"),
    "application": ("application", "app_run_bridge"),
    "guarantee": ("prequal_decision",),
    "merchant": ("merchant_dim", "risky_merchant", "merchant_segment"),
    "user": ("user_dim",),
    "prequal": ("prequal",),
}
#: Affected rows up to which the lookups' large tables are cut to the rows these can join.
PRUNE_ROWS = 1_000_000


def keyed_mart(sources: dict[str, DataFrame], p: MartParams | None = None, bucket_seconds: int | None = 3600) -> DataFrame:
    """The mart with its row key: the application ids of the late and the early stage."""
    p = p or MartParams()
    return mart_columns(enriched_spine(sources, p, bucket_seconds, narrow=True), p, ROW_KEY)


def _keys(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("k")).where(F.col("k").isNotNull()).distinct()


def _holding(df: DataFrame, column: str, keys: DataFrame | None, wanted: str) -> DataFrame | None:
    """Column ``wanted`` of the rows of ``df`` whose ``column`` is among ``keys``."""
    if keys is None:
        return None
    return df.join(keys, F.col(column) == F.col("k"), "left_semi").select(F.col(wanted).alias("k")).where(F.col("k").isNotNull())


def _union(*parts: DataFrame | None) -> DataFrame | None:
    found = [x for x in parts if x is not None]
    return reduce(DataFrame.unionByName, found).distinct() if found else None


def touched_keys(s: dict[str, DataFrame], changes: dict[str, DataFrame], p: MartParams) -> dict[str, DataFrame]:
    """Ids of the stages that changed keys lead to: kind of id -> column k. Kinds that nothing leads to are left out."""
    unknown = set(changes) - set(CHANGE_KEYS)
    if unknown:
        raise ValueError(f"changes of unknown roles: {sorted(unknown)}")
    c = {role: _keys(df, CHANGE_KEYS[role]) for role, df in changes.items()}
    metro = c.get("risky_metro")
    postal = _union(c.get("postal_metro"), _holding(s["postal_metro"], "metro", metro, "postal_code"))
    address = _union(c.get("address"), _holding(s["address"], "postal_code", postal, "address_id"))
    rated = None
    if metro is not None:
        states = s.get("signal_states")
        signals = underwriting_signals(s["app_run_bridge"], s["decision_run"], p) if states is None else signals_from_states(states, p)
        rated = _holding(signals, "metro", metro, "application_id")
    chained = {
        "application": (
            _holding(s["application"], "billing_address_id", address, "application_id"),
            _holding(s["app_run_bridge"], "run_id", c.get("decision_run"), "application_id"),
            rated,
        ),
        "guarantee": (_holding(s["prequal_decision"], "user_id", c.get("card_state_event"), "guarantee_id"),),
        "user": (_holding(s["user_dim"], "person_id", c.get("person_stats"), "user_id"),),
    }
    out = {kind: _union(*[c.get(r) for r in roles], *chained.get(kind, ())) for kind, roles in DIRECT.items()}
    return {kind: keys for kind, keys in out.items() if keys is not None}


def marked(df: DataFrame, sets: dict[str, DataFrame]) -> DataFrame:
    """``df`` with boolean ``hit``: is any of these columns among its keys? One pass; each set is unique."""
    marks = []
    for i, (column, keys) in enumerate(sets.items()):
        df = df.join(keys.select(F.col("k").alias(f"__k{i}"), F.lit(True).alias(f"__m{i}")), F.col(column) == F.col(f"__k{i}"), "left")
        marks.append(F.coalesce(F.col(f"__m{i}"), F.lit(False)))
    hit = reduce(lambda a, b: a | b, marks, F.lit(False))
    return df.withColumn("hit", hit).drop(*[f"__{x}{i}" for i in range(len(sets)) for x in "km"])


def touched_stages(s: dict[str, DataFrame], changes: dict[str, DataFrame], p: MartParams) -> tuple[DataFrame, DataFrame]:
    """Application ids (k) of the late and of the early rows whose mart rows may differ."""
    kinds = touched_keys(s, changes, p)
    stage_changes = {r: changes[r] for r in ("checkout_funnel", "prequal_funnel") if r in changes}
    # A stage row that is new, gone or linked otherwise also touches the rows it is or was linked with.
    links = _union(*[_keys(df, "prequal_id") for df in stage_changes.values()])
    found = []
    for stage, more in (
        ("checkout_funnel", ("checkout", "charge", "application", "guarantee", "merchant", "user")), ("prequal_funnel", ("merchant", "user", "prequal"))
    ):
        sets = {f"{kind}_id": kinds[kind] for kind in more if kind in kinds}
        if links is not None:
            sets["prequal_id"] = _union(sets.get("prequal_id"), links)
        rows = None
        if sets:
            narrow = s[stage].select("application_id", *[x for x in sets if x != "application_id"])
            rows = marked(narrow, sets).where("hit").select(F.col("application_id").alias("k"))
        own = _keys(stage_changes[stage], "application_id") if stage in stage_changes else None
        found.append(_union(rows, own))
    nothing = s["checkout_funnel"].select(F.col("application_id").alias("k")).limit(0)
    return tuple(nothing if x is None else x for x in found)


def pruned_sources(s: dict[str, DataFrame], late: DataFrame) -> dict[str, DataFrame]:
    """The roles joined by a late row's own ids, cut to what ``late`` can join: a semi-join with a list of checked
    size, so that their tables are filtered where they are read and not shuffled whole."""
    out = {}
    for kind, roles in DIRECT.items():
        column = f"{kind}_id"
        if kind in ("checkout", "charge", "application", "guarantee"):
            keys = F.broadcast(_keys(late, column))
            for role in roles:
                out[role] = s[role].join(keys, F.col(CHANGE_KEYS[role]) == F.col("k"), "left_semi")
    return out


def refresh_mart(
    old: DataFrame, sources: dict[str, DataFrame], changes: dict[str, DataFrame], p: MartParams | None = None, bucket_seconds: int | None = 3600
) -> DataFrame:
    """``keyed_mart(sources, p)``, from the mart as it was (``old``, a written ``keyed_mart`` under the same ``p``) and the keys
    that changed since: role -> rows with the role's column of ``CHANGE_KEYS``, of rows that are new, gone or different. Changes
    of the two stages also carry prequal_id, with its values before and after. Keys that did not change do no
    harm. ``sources`` are the roles as they are now.
    """
    p = p or MartParams()
    # Each set of ids is used several times; as a table it is computed once and its size is known.
    late_ids, early_ids = (written(ids, name) for ids, name in zip(touched_stages(sources, changes, p), ROW_KEY))
    late, early = sources["checkout_funnel"], sources["prequal_funnel"]
    # All rows that stand in a mart row with a touched one.
    linked = lambda df, ids: _holding(df, "application_id", ids, "prequal_id").distinct()
    late_rows = marked(late, {"application_id": late_ids, "prequal_id": linked(early, early_ids)}).where("hit").drop("hit")
    early_rows = marked(early, {"application_id": early_ids, "prequal_id": linked(late, late_ids)}).where("hit").drop("hit")
    late_rows, early_rows = written(late_rows, "late"), written(early_rows, "early")
    s = sources | {"checkout_funnel": late_rows, "prequal_funnel": early_rows, "late_links": late.select("prequal_id")}
    if late_rows.limit(PRUNE_ROWS + 1).count() <= PRUNE_ROWS:
        s |= pruned_sources(sources, late_rows)
    ids = {"late_id": late_ids, "early_id": early_ids}
    new = marked(keyed_mart(s, p, bucket_seconds), ids).where("hit").drop("hit")
    return marked(old, ids).where(~F.col("hit")).drop("hit").unionByName(new)
