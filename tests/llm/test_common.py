import random

import pytest

from maskwright.llm.common import lookup


@pytest.mark.parametrize("pairs, hot", [(1499, 1), (600, 900), (0, 5000), (1, 0), (0, 0)])
def test_lookup_against_a_dict(spark, pairs, hot):
    keys = [f"k{i}" for i in range(pairs)] * 2 + ["hot"] * hot + [f"one{i}" for i in range(40)]
    random.Random(1).shuffle(keys)
    left = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id long, key string")
    known = {k: (keys.count(k) if k == "hot" else 2, f"v-{k}") for k in {*keys} if not k.startswith("one")}
    right = spark.createDataFrame([(k, n, v) for k, (n, v) in known.items()], "key string, n long, value string")
    got = {r.id: r.value for r in lookup(left, right, "key", "n", "id").collect()}
    assert got == {i: known[k][1] if k in known else None for i, k in enumerate(keys)}
    inner = {r.id for r in lookup(left, right, "key", "n", "id", how="inner").collect()}
    assert inner == {i for i, k in enumerate(keys) if k in known}


def test_released_gives_memory_back_and_changes_no_rows(spark):
    from maskwright.llm.common import released

    def held():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    @released
    def run(batches):
        for batch in batches:
            junk = [bytes(1000) for _ in range(200_000)]  # 200 MB in small pieces, which stay with the allocator else
            last = junk[-1]
            del junk
            yield batch
            del last

    before = held()
    assert list(run(iter(range(3)))) == [0, 1, 2]
    assert held() - before < 50_000_000
    assert spark.range(5).mapInArrow(run, "id long").count() == 5


def test_sliced_keeps_rows_and_order():
    import pyarrow as pa

    from maskwright.llm.common import sliced

    batches = [pa.RecordBatch.from_pydict({"a": list(range(i, i + n))}) for i, n in ((0, 2500), (2500, 0), (2500, 1000), (3500, 1))]
    out = list(sliced(iter(batches)))
    assert max(b.num_rows for b in out) == 1000
    assert [x for b in out for x in b.column(0).to_pylist()] == list(range(3501))
