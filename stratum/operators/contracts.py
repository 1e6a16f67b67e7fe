"""Transactions of the ledger's contracts, as rules over tables.

All transactions of a block read the state before the block, and of several writes of a key the last counts: two
increments of an account in one block count once. With serial=True each transaction sees the one before.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = 1 << 256
#: SmallBank's operations, by number.
ALMAGATE, GET_BALANCE, UPDATE_BALANCE, UPDATE_SAVING, SEND_PAYMENT, WRITE_CHECK = range(1, 7)


def touches(transfers: DataFrame, serial: bool = False) -> DataFrame:
    """(account, n): how often each account was incremented, as either side of a transfer (block, sender, receiver)."""
    sides = transfers.select("block", F.explode(F.array("sender", "receiver")).alias("account"))
    n = F.count("*") if serial else F.count_distinct("block")
    return sides.groupBy("account").agg(n.alias("n"))


def balances(deposits: DataFrame) -> DataFrame:
    """(account, checking, saving, total) from deposits (account, kind, amount) that only add."""
    part = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("amount"))), F.lit(0))
    both = deposits.groupBy("account").agg(part("checking").alias("checking"), part("saving").alias("saving"))
    return both.withColumn("total", F.col("checking") + F.col("saving"))


def apply(op: int, a: int, b: int, amount: int, read) -> list[tuple[str, int, int]]:  # noqa: ANN001
    """Writes (table, account, value) of one SmallBank operation; read(table, account) gives a balance. Numbers wrap at 256 bits."""
    if op == ALMAGATE:
        return [("checking", a, 0), ("saving", b, (read("saving", a) + read("checking", b)) % WORD)]
    if op == UPDATE_BALANCE:
        return [("checking", a, (read("checking", a) + amount) % WORD)]
    if op == UPDATE_SAVING:
        return [("saving", a, (read("saving", a) + amount) % WORD)]
    if op == SEND_PAYMENT:
        return [("checking", a, (read("checking", a) - amount) % WORD), ("checking", b, (read("checking", b) + amount) % WORD)]
    if op == WRITE_CHECK:
        total = (read("checking", a) + read("saving", a)) % WORD
        return [("checking", a, (read("checking", a) - amount - (amount < total)) % WORD)]
    return []


def execute(transactions: DataFrame, by: str = "shard", serial: bool = False) -> DataFrame:
    """(shard, name, account, value): balances, as decimal strings, after the transactions (shard, block, seq, op, a, b, amount).

    Operations couple accounts, so a shard's blocks run one after another; accounts of different shards must not
    meet. An account that no transaction writes gives no row.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state: dict[tuple[str, int], int] = {}
        columns = ["op", "a", "b", "amount"]
        for _, block in pdf.sort_values(["block", "seq"]).groupby("block", sort=True):
            written = state if serial else {}  # what the block writes, beside the state before it
            for op, a, b, amount in block[columns].itertuples(index=False):
                for table, account, value in apply(int(op), int(a), int(b), int(amount), lambda t, x: state.get((t, x), 0)):
                    written[table, account] = value
            state.update(written)
        return pd.DataFrame({by: pdf[by].iloc[0], "name": [k[0] for k in state], "account": [k[1] for k in state], "value": [str(v) for v in state.values()]})

    kind = transactions.schema[by].dataType.simpleString()
    return transactions.groupBy(by).applyInPandas(run, f"{by} {kind}, name string, account long, value string")


def deposit_transfers(transactions: DataFrame, serial: bool = False) -> DataFrame:
    """(account, value): balances as decimal strings after transactions (block, seq, op, a, b, amount) of the transfer contract: op 1 adds amount to a, op 2 moves it from a to b if a has as much.

    Accounts couple all transactions, so they run one after another, block by block; a block reads the state before it unless serial.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state: dict[int, int] = {}
        for _, block in pdf.sort_values(["block", "seq"]).groupby("block", sort=True):
            written = state if serial else {}
            for op, a, b, amount in block[["op", "a", "b", "amount"]].itertuples(index=False):
                has = state.get(a, 0)
                if op == 1:
                    written[a] = (has + int(amount)) % WORD
                elif op == 2 and has >= amount:
                    written[b] = (state.get(b, 0) + int(amount)) % WORD
                    written[a] = has - int(amount) if a != b else has
            state.update(written)
        return pd.DataFrame({"shard": pdf["shard"].iloc[0], "account": list(state), "value": [str(v) for v in state.values()]})

    kind = transactions.schema["shard"].dataType.simpleString()
    return transactions.groupBy("shard").applyInPandas(run, f"shard {kind}, account long, value string")


def kv_results(operations: DataFrame) -> DataFrame:
    """(seq, key, value): what each READ of key-value operations (seq, op, key, value) finds: the value that the last operation before it wrote, null if none did."""
    written = F.when(F.col("op") != "READ", F.struct("value"))
    before = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = operations.withColumn("found", F.last(written, True).over(before))
    return rows.where("op = 'READ'").select("seq", "key", F.col("found.value").alias("value"))


def stored_numbers(calls: DataFrame) -> DataFrame:
    """(contract, value) of the storage contract's calls (contract, seq, value): what the last call set. Calls of a contract that does nothing have no rows here."""
    return calls.groupBy("contract").agg(F.max_by("value", "seq").alias("value"))


def scanned(changes: DataFrame, low: Column, high: Column, descending: bool = False) -> DataFrame:
    """Keys from low to high in their order, or the reverse."""
    rows = changes.where(F.col("slot").between(low, high))
    return rows.orderBy(F.desc("slot") if descending else F.asc("slot"))


def sorted_numbers(numbers: Column) -> Column:
    """The CPU-heavy contract: an array in rising order."""
    return F.array_sort(numbers)


def contract_address(creator: Column, nonce: Column) -> Column:
    """A stable 20-byte id of a contract from its creator and nonce, in hexadecimal."""
    return F.substring(F.sha2(F.concat(F.coalesce(creator.cast("string"), F.lit("-")), F.lit("|"), F.coalesce(nonce.cast("string"), F.lit("-"))).cast("binary"), 256), 25, 40)


def write_sets(writes: DataFrame) -> DataFrame:
    """Write sets merged in the order of seq (addr, slot, seq, value, reset): values after an address's last reset, the latest of each slot.

    A reset row clears all slots of its address; its own slot and value are not read.
    """
    resets = writes.where("reset").groupBy("addr").agg(F.max("seq").alias("cleared"))
    live = writes.where("not reset").join(resets, "addr", "left").where("cleared is null or seq > cleared")
    return live.groupBy("addr", "slot").agg(F.max_by("value", "seq").alias("value"))
