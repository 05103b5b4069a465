"""Transaction typing: an ordered rule table folded into one `when` chain.

A rule holds when its kind matches and every part it names matches; the first rule that holds gives the
type. The chain stays inside whole-stage codegen, so typing is a projection with no shuffle of its own.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, functions as F

NOT_SET = "Not Set"


class Rule(NamedTuple):
    label: str
    kind: str                      # raw type; a trailing * matches by prefix
    methods: tuple = ()
    subtypes: tuple = ()
    until: str | None = None       # created <= date
    before: str | None = None      # created <  date
    since: str | None = None       # created >= date
    comments: tuple = ()           # comment is one of these ...
    contains: tuple = ()           # ... or holds one of these in any case ...
    like: tuple = ()               # ... or matches one of these patterns in this case


DEP, WD, CIN, COUT = "Deposit", "Withdraw*", "Credit In", "Credit Out"
PAY_LIVE = ("Credit card", "Electronic payment", "Wire transfer", "CryptoWallet", "Cash")
PAY_ALL = ("None", "Wire", "Credit card", "ElectronicPayment", "Electronic payment", "Wire transfer",
           "Crypto", "CryptoWallet", "Cash", "External", "CreditCard")
FRF_WORDS = ("FRF Commission", "Refer a friend", "FRF Bonus")

# The typing rules in the order they apply.
RULES = (
    # introducing-broker commission
    Rule("IB Commission", DEP, ("Adjustment",), ("IB Commission",), until="2023-01-01"),
    Rule("IB Commission", DEP, ("Commission",), ("IB Commission",), until="2023-01-01"),
    Rule("IB Commission", DEP, ("Commission",), until="2023-01-01",
         comments=("Affiliate Payment To Trading Pl",)),
    Rule("IB Commission Cancelled", WD, ("Adjustment",), ("IB Commission",), until="2023-01-01"),
    Rule("IB Commission Cancelled", WD, ("Commission",), ("IB Commission",), until="2023-01-01"),
    Rule("IB Commission PayOut Cancelled", DEP, ("IB commission",),
         comments=("IB Commission PayOut Cancelled", "IB Commission PayOut Void")),
    Rule("IB Commission", DEP, ("IB commission",), comments=("IB Commission",)),
    Rule("IB Commission PayOut", WD, ("IB commission",), until="2023-01-01"),
    Rule("IB Commission Cancelled", WD, ("IB commission",), comments=("IB Commission Void",)),
    Rule("IB Commission PayOut", WD, ("IB commission",), comments=("IB Commission PayOut",)),
    # refer-a-friend commission
    Rule("FRF Commission", DEP, ("Commission",), ("FRF Commission",), until="2022-12-05"),
    Rule("FRF Commission", DEP, ("Adjustment",), ("FRF Commission",), until="2022-12-05"),
    Rule("FRF Commission Cancelled", WD, ("Commission",), ("FRF Commission",), until="2022-12-05"),
    Rule("FRF Commission Cancelled", WD, ("Adjustment",), ("FRF Commission",), until="2022-12-05"),
    Rule("FRF Commission PayOutCancelled", DEP, ("FRF commission",), since="2022-12-05",
         comments=("FRF PayOut Cancelled", "FRF PayOut Void")),
    Rule("FRF Commission Transfer to Balance", DEP, ("FRF commission",), since="2022-12-05",
         comments=("FRF - Transfer to Balance",)),
    Rule("FRF Commission Transfer to Balance Cancelled", WD, ("FRF commission",), since="2022-12-05",
         comments=("FRF - Transfer to Balance Void",)),
    Rule("FRF Commission PayOut", WD, ("FRF commission",), since="2022-12-05", comments=("FRF PayOut",)),
    Rule("FRF Commission Cancelled", WD, ("FRF commission",), before="2022-12-05"),
    Rule("FRF Commission", DEP, ("FRF commission",), before="2022-12-05"),
    Rule("FRF Commission", CIN, comments=("FRF",), contains=FRF_WORDS),
    Rule("FRF Commission Cancelled", COUT, comments=("FRF Void",), contains=FRF_WORDS),
    # credit advance
    Rule("Credit In Advance", CIN, contains=("advance",)),
    Rule("Credit In Advance Cancelled", COUT, contains=("advance",)),
    # bonus
    Rule("Bonus", DEP, ("Bonus",), until="2022-11-01"),
    Rule("Bonus", DEP, ("Bonus",), comments=("Deposit,Bonus", "Bonus", "CashBack Bonus")),
    Rule("Bonus Transfer to Balance", DEP, ("Bonus",), like=("%Transfer to Balance%",)),
    Rule("Bonus Transfer to Balance Cancelled", WD, ("Bonus",), like=("Bonus Transfer to Balance Cancel%",)),
    Rule("Bonus PayOut Cancelled", DEP, ("Bonus",), comments=("Bonus PayOut Cancelled", "Bonus PayOut Void")),
    Rule("BonusCancelled", WD, ("Bonus",), until="2022-11-01"),
    Rule("Bonus PayOut", WD, ("Bonus",), comments=("Bonus PayOut",)),
    Rule("BonusCancelled", WD, ("Bonus",)),
    Rule("Bonus", CIN),
    Rule("BonusCancelled", COUT),
    # deposits and withdrawals
    Rule("Deposit Cancelled", WD, ("Adjustment",), ("Deposit Void",), until="2023-01-01"),
    Rule("Withdrawal Cancelled", DEP, ("Adjustment",), ("Withdrawal Void",), until="2023-01-01"),
    Rule("Deposit Cancelled", WD, PAY_LIVE, comments=("Deposit Cancelled", "Deposit Void")),
    Rule("Withdrawal Cancelled", DEP, PAY_LIVE, comments=("Withdrawal Cancelled", "Withdrawal Void")),
    Rule("Deposit", DEP, PAY_ALL),
    Rule("Withdrawal", WD, PAY_ALL),
    Rule("Charge Back Cancelled", DEP, ("Chargeback",)),
    Rule("Charge Back", WD, ("Chargeback",)),
    Rule("Fee Cancelled", DEP, ("Processing fees",)),
    Rule("Fee", "Fee"),
    Rule("Fee", WD, ("Processing fees", "Fee", "ProcessingFee")),
    Rule("Transfer To Account", DEP, ("Transfer",)),
    Rule("Transfer To Account", "TransferIn"),
    Rule("Transfer From Account", WD, ("Transfer",)),
    Rule("Transfer From Account", "TransferOut"),
    Rule("Gift", DEP, ("Adjustment",), ("Gift",), before="2023-01-01"),
    Rule("Gift", DEP, ("Commission",), ("Gift",), before="2023-01-01"),
    Rule("Gift Cancelled", WD, ("Adjustment",), ("Gift",), before="2023-01-01"),
    Rule("Gift Cancelled", WD, ("Commission",), ("Gift",), before="2023-01-01"),
    Rule("Transfer To Account", DEP, ("Adjustment",), contains=("transfer",)),
    Rule("Transfer From Account", WD, ("Adjustment",), contains=("transfer",)),
    Rule("Positive Trading Adjustment", DEP, ("Adjustment",)),
    Rule("Negative Trading Adjustment", WD, ("Adjustment",)),
)


def _all(tests):
    return reduce(lambda a, b: a & b, tests)


def _any(tests):
    return reduce(lambda a, b: a | b, tests)


def rule_condition(r: Rule, kind: Column, method: Column, subtype: Column, created: Column,
                   note: Column) -> Column:
    tests = [kind.startswith(r.kind[:-1]) if r.kind.endswith("*") else kind == r.kind]
    if r.methods:
        tests.append(method.isin(*r.methods))
    if r.subtypes:
        tests.append(subtype.isin(*r.subtypes))
    for bound, test in ((r.until, created.__le__), (r.before, created.__lt__), (r.since, created.__ge__)):
        if bound:
            tests.append(test(F.lit(bound).cast("timestamp_ntz")))
    notes = ([note.isin(*r.comments)] if r.comments else []) + \
        [note.ilike(f"%{w}%") for w in r.contains] + [note.like(p) for p in r.like]
    if notes:
        tests.append(_any(notes))
    return _all(tests)


def classify(kind="raw_type", method="method", subtype="subtype", created="created", note="op_comment",
             rules=RULES, default: str = NOT_SET) -> Column:
    cols = [F.col(c) for c in (kind, method, subtype, created, note)]
    chain = F.when(rule_condition(rules[0], *cols), F.lit(rules[0].label))
    for r in rules[1:]:
        chain = chain.when(rule_condition(r, *cols), F.lit(r.label))
    return chain.otherwise(F.lit(default))
