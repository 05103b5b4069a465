"""Labels written by hand for a payment of each kind that the typing rules tell apart."""

from pyspark.sql import functions as F

from ledgerlight.functions import typing

# (raw type, method, subtype, created, comment) -> label
CASES = [
    ("Deposit", "Adjustment", "IB Commission", "2022-06-01", None, "IB Commission"),
    ("Deposit", "Commission", "IB Commission", "2022-06-01", None, "IB Commission"),
    ("Deposit", "Commission", None, "2022-06-01", "Affiliate Payment To Trading Pl", "IB Commission"),
    ("Withdrawal", "Adjustment", "IB Commission", "2022-06-01", None, "IB Commission Cancelled"),
    ("Withdrawal", "Commission", "IB Commission", "2022-06-01", None, "IB Commission Cancelled"),
    ("Deposit", "IB commission", None, "2024-01-01", "IB Commission PayOut Void", "IB Commission PayOut Cancelled"),
    ("Deposit", "IB commission", None, "2024-01-01", "IB Commission", "IB Commission"),
    ("Withdrawal", "IB commission", None, "2022-06-01", None, "IB Commission PayOut"),
    ("Withdrawal", "IB commission", None, "2024-01-01", "IB Commission Void", "IB Commission Cancelled"),
    ("Withdrawal", "IB commission", None, "2024-01-01", "IB Commission PayOut", "IB Commission PayOut"),
    ("Withdrawal", "IB commission", None, "2024-01-01", None, "Not Set"),
    ("Deposit", "Commission", "FRF Commission", "2022-12-05", None, "FRF Commission"),
    ("Deposit", "Commission", "FRF Commission", "2022-12-06", None, "Not Set"),
    ("Deposit", "Adjustment", "FRF Commission", "2022-01-01", None, "FRF Commission"),
    ("Deposit", "Adjustment", "FRF Commission", "2023-02-01", None, "Positive Trading Adjustment"),
    ("Withdrawal", "Commission", "FRF Commission", "2022-01-01", None, "FRF Commission Cancelled"),
    ("Withdrawal", "Adjustment", "FRF Commission", "2022-01-01", None, "FRF Commission Cancelled"),
    ("Deposit", "FRF commission", None, "2023-01-01", "FRF PayOut Void", "FRF Commission PayOutCancelled"),
    ("Deposit", "FRF commission", None, "2023-01-01", "FRF - Transfer to Balance", "FRF Commission Transfer to Balance"),
    ("Withdrawal", "FRF commission", None, "2023-01-01", "FRF - Transfer to Balance Void", "FRF Commission Transfer to Balance Cancelled"),
    ("Withdrawal", "FRF commission", None, "2023-01-01", "FRF PayOut", "FRF Commission PayOut"),
    ("Withdrawal", "FRF commission", None, "2022-12-04", None, "FRF Commission Cancelled"),
    ("Deposit", "FRF commission", None, "2022-12-04", None, "FRF Commission"),
    ("Credit In", None, None, "2023-01-01", "a REFER A FRIEND gift", "FRF Commission"),
    ("Credit Out", None, None, "2023-01-01", "FRF Void", "FRF Commission Cancelled"),
    ("Credit In", None, None, "2023-01-01", "Cash ADVANCE", "Credit In Advance"),
    ("Credit Out", None, None, "2023-01-01", "cash advance back", "Credit In Advance Cancelled"),
    ("Deposit", "Bonus", None, "2022-11-01", None, "Bonus"),
    ("Deposit", "Bonus", None, "2023-01-01", "CashBack Bonus", "Bonus"),
    ("Deposit", "Bonus", None, "2023-01-01", "my Transfer to Balance x", "Bonus Transfer to Balance"),
    ("Deposit", "Bonus", None, "2023-01-01", "my transfer to balance x", "Not Set"),
    ("Withdrawal", "Bonus", None, "2023-01-01", "Bonus Transfer to Balance Cancelled", "Bonus Transfer to Balance Cancelled"),
    ("Deposit", "Bonus", None, "2023-01-01", "Bonus PayOut Void", "Bonus PayOut Cancelled"),
    ("Withdrawal", "Bonus", None, "2022-10-01", None, "BonusCancelled"),
    ("Withdrawal", "Bonus", None, "2023-01-01", "Bonus PayOut", "Bonus PayOut"),
    ("Withdrawal", "Bonus", None, "2023-01-01", "else", "BonusCancelled"),
    ("Credit In", None, None, "2023-01-01", None, "Bonus"),
    ("Credit Out", None, None, "2023-01-01", None, "BonusCancelled"),
    ("Withdrawal", "Adjustment", "Deposit Void", "2022-06-01", None, "Deposit Cancelled"),
    ("Deposit", "Adjustment", "Withdrawal Void", "2022-06-01", None, "Withdrawal Cancelled"),
    ("Withdrawal", "Credit card", None, "2023-01-01", "Deposit Void", "Deposit Cancelled"),
    ("Deposit", "Wire transfer", None, "2023-01-01", "Withdrawal Cancelled", "Withdrawal Cancelled"),
    ("Deposit", "Crypto", None, "2023-01-01", None, "Deposit"),
    ("Withdraw", "Cash", None, "2023-01-01", None, "Withdrawal"),
    ("Deposit", "Chargeback", None, "2023-01-01", None, "Charge Back Cancelled"),
    ("Withdrawal", "Chargeback", None, "2023-01-01", None, "Charge Back"),
    ("Deposit", "Processing fees", None, "2023-01-01", None, "Fee Cancelled"),
    ("Fee", None, None, "2023-01-01", None, "Fee"),
    ("Withdrawal", "ProcessingFee", None, "2023-01-01", None, "Fee"),
    ("Deposit", "Transfer", None, "2023-01-01", None, "Transfer To Account"),
    ("TransferIn", None, None, "2023-01-01", None, "Transfer To Account"),
    ("Withdrawal", "Transfer", None, "2023-01-01", None, "Transfer From Account"),
    ("TransferOut", None, None, "2023-01-01", None, "Transfer From Account"),
    ("Deposit", "Adjustment", "Gift", "2022-12-31", None, "Gift"),
    ("Deposit", "Commission", "Gift", "2022-12-31", None, "Gift"),
    ("Withdrawal", "Adjustment", "Gift", "2022-12-31", None, "Gift Cancelled"),
    ("Withdrawal", "Commission", "Gift", "2022-12-31", None, "Gift Cancelled"),
    ("Deposit", "Adjustment", "Gift", "2023-01-01", "a Transfer in", "Transfer To Account"),
    ("Withdrawal", "Adjustment", None, "2023-01-01", "transfer out", "Transfer From Account"),
    ("Deposit", "Adjustment", None, "2023-01-01", None, "Positive Trading Adjustment"),
    ("Withdrawal", "Adjustment", None, "2023-01-01", None, "Negative Trading Adjustment"),
    ("Deposit", "Unheard of", None, "2023-01-01", None, "Not Set"),
    (None, None, None, None, None, "Not Set"),
]


def test_every_rule(spark):
    rows = [(i, *case) for i, case in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, raw_type string, method string, subtype string, created string, op_comment string, label string")
    df = df.withColumn("created", F.col("created").cast("timestamp_ntz"))
    wrong = df.withColumn("got", typing.classify()).where("got <> label").collect()
    assert not wrong


def test_every_label_is_tried():
    assert {r.label for r in typing.RULES} <= {case[-1] for case in CASES}
