"""What tasks of least squares and of k-means hold for each cell, and what a fetch holds beside its rows."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tidemark.operators import als, kmeans
from tidemark.operators.peers import Peers, Routes


def _peak(run) -> int:
    tracemalloc.start()
    run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def test_cells_without_values_take_a_number_each_and_are_sorted_in_place():
    rng = np.random.default_rng(3)
    n, ids = 1 << 22, np.arange(1000)
    a, b, at = rng.integers(0, 1000, n), rng.integers(0, 1000, n), np.zeros(n, np.int32)
    kept = []
    assert _peak(lambda: kept.append(als.Cells(Peers(), ids, ids, a, b, at))) < 24 * n
    order = np.lexsort((b, a))
    assert (kept[0].col == b[order]).all() and (kept[0].bounds == np.searchsorted(a[order], np.arange(1001))).all()


def test_columns_are_not_held():
    n, some = 1 << 21, 1 << 16
    batch = pa.RecordBatch.from_arrays([pa.array(np.full(some, als.USER_CELLS, np.int32)), pa.array(np.arange(some)), pa.array(np.arange(some)), pa.array(np.zeros(some, np.int32))], names=["kind", "a", "b", "at"])
    held = []
    assert _peak(lambda: held.append(als._held((batch for _ in range(n // some)), als._USED_ALIKE))) < 8 * n
    assert all((x == np.tile(np.arange(some), n // some)).all() for x in als.columns(held[0], als.USER_CELLS, "a", "b"))


def test_a_fetch_holds_its_rows_once_more():
    ids = np.arange(1 << 16)
    routes, rows = Routes(Peers(), ids[::-1].copy(), np.zeros(len(ids), np.int64), ids), np.random.default_rng(1).random((len(ids), 16))
    got = []
    assert _peak(lambda: got.append(routes.fetch(rows))) < 2.2 * rows.nbytes
    assert (got[0] == rows[::-1]).all()


def test_k_means_holds_few_numbers_a_one():
    rng = np.random.default_rng(2)
    n, some = 1 << 21, 1 << 13
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + some)), pa.array(list(np.sort(rng.integers(0, 4000, (some, 16)), axis=1)), pa.list_(pa.int64()))], names=["id", "ones"]) for lo in range(0, n // 16, some)]
    assert _peak(lambda: list(kmeans.Lloyd(4000, [[[1, 2], [3, 4]]], 2, False).run(iter(batches)))) < 24 * n
