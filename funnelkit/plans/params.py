"""Run parameters of the mart: dates, identifier lists, cut-offs and output labels.

The reference hard-codes one company's identifiers, product names and cut-offs; here
they are all parameters. The defaults below are the ones the fixture tables are built
for (merchant ids are the fixture's small integer ids), not values of any real system.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Labels:
    # funnel stage (G1), prequal flag (G17), proactive flag
    early_no_late: str = "prequal, no checkout yet"
    early_at_late: str = "prequal at checkout"
    late_only: str = "checkout without prequal"
    prequal: str = "prequal"
    non_prequal: str = "non prequal"
    proactive: str = "proactive"
    other: str = "other"
    # customer flags
    repeat: str = "repeat"
    new: str = "new"
    not_in_group: str = "not in group"
    new_to_group: str = "new to group"
    repeat_in_group: str = "repeat in group"
    unknown: str = "unknown"
    # offers (G9)
    no_offer: str = "no offer"
    # application category
    platform: str = "platform"
    card: str = "card"
    direct: str = "direct"
    core: str = "core"
    # plan families and kinds
    short: str = "short"
    instalment: str = "instalment"
    card_direct: str = "card/direct"
    not_captured: str = "not captured"
    pay_in_30: str = "pay in 30"
    pay_in_2: str = "pay in 2"
    four_biweekly: str = "4 biweekly"
    pay_in_4: str = "pay in 4"
    # merchant category
    core_interest: str = "core interest bearing"
    core_zero: str = "core zero or fixed apr"
    # autopay (G18)
    autopay_on: str = "autopay on"
    autopay_off: str = "autopay off"

    def kind(self, family: str, kind: str) -> str:
        return f"{family} {kind}"


@dataclass(frozen=True)
class MartParams:
    start: dt.date = dt.date(2000, 1, 1)
    # "today" of the run; the reference reads the clock (trap T6).
    as_of: dt.date = dt.date(2002, 1, 1)
    lookback_days: int = 365
    # S1 decision log filter
    decision_types: tuple[str, ...] = ("terms",)
    report_sentinels: tuple[str, ...] = ("none",)
    # B5 prequal stage
    prequal_states: tuple[str, ...] = ("approved", "declined")
    approved_state: str = "approved"
    proactive_type: str = "proactive"
    # retailer groups (G10, G15): label -> merchant ids, first match wins
    retailer_groups: tuple[tuple[str, tuple[int | str, ...]], ...] = (
        ("retailer a", (4,)),
        ("retailer b", (5,)),
        ("retailer c", (6,)),
        ("retailer d", (1,)),
    )
    # the retailer with its own approval rules and group flag
    focus_retailer_ids: tuple[int | str, ...] = (1,)
    # merchants eligible for the card/direct products without a guarantee
    direct_merchant_ids: tuple[int | str, ...] = (2,)
    direct_product_type: str = "direct"
    own_label: str = "own"
    card_platform: str = "network"
    card_instrument: str = "debit"
    card_group_pattern: str = "card plus%"
    platform_flow_type: str = "platform flow"
    short_flow_types: tuple[str, ...] = ("express", "split express")
    classic_loan: str = "classic"
    go_loan: str = "go"
    split_loans: tuple[str, ...] = ("go", "split go", "express go")
    # G6/G7 approval cut-offs
    split_pattern: str = "%2_high%"
    cap_instalment: float = 250000.0
    cap_split: float = 150000.0
    cut_instalment: dt.date = dt.date(1997, 7, 1)
    cut_split: dt.date = dt.date(1999, 11, 1)
    apr_threshold: float = 0.09
    # G21 partner ids -> labels
    partner_labels: tuple[tuple[str, str], ...] = (
        ("p1", "wallet one"),
        ("p2", "wallet two"),
        ("p3", "wallet three"),
    )
    # G22 pattern on the risk-list flag
    risk_flag_pattern: str = "%bad outcome%"
    # H4 / H2 / H3 sentinels
    dp_sentinel: float = 999999.0
    labels: Labels = field(default_factory=Labels)
