"""Stored tables: the content index, and tables changed by bucket."""

import os
import random

from pyspark.sql import functions as F

from tidings import constants as K
from tidings.functions.common import ts_lit
from tidings.operators import dedup, frontier as FR
from tidings.operators.bandindex import ContentIndex
from tidings.operators.ranks import positions
from tidings.operators.stored import BucketedTable

from test_plans import _plan

AS_OF = "2024-01-31 12:00:00"


def _signed(v):
    return v - (1 << 64) if v >= 1 << 63 else v


def _content(seed, n, base, start=0):
    """Rows (id, url, simhash): copies of ``base`` with some bits flipped."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        v = r.choice(base)
        for b in r.sample(range(64), r.choice([0, 3, 12, 24, 30])):
            v ^= 1 << b
        out.append((start + i, f"u{start + i}", _signed(v)))
    return out


def _frame(spark, rows):
    return spark.createDataFrame(rows, "id long, url string, simhash long")


def _files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_index_gives_what_the_join_gives(spark, tmp_path):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(12)]
    stored, incoming = _frame(spark, _content(2, 200, base)), _frame(spark, _content(3, 120, base, 1000))
    want = sorted(map(tuple, dedup.near_dup_urls(incoming, stored).collect()))
    assert 0 < len(want) < 120
    for salts in (1, 3):
        index = ContentIndex(spark, str(tmp_path / f"i{salts}"), buckets=4, salts=salts)
        index.add(stored.limit(0))
        assert index.near_dup_urls(incoming).count() == 0
        index.add(stored)
        assert sorted(map(tuple, index.near_dup_urls(incoming).collect())) == want
        smaller = index.bands.compacted(str(tmp_path / f"c{salts}"))
        index.bands = smaller
        assert sorted(map(tuple, index.near_dup_urls(incoming).collect())) == want
        known = index.unknown_urls(_frame(spark, [(1, "u5", 0), (2, "new", 0)]))
        assert [x["url"] for x in known.collect()] == ["new"]


def test_stored_side_is_not_shuffled(spark, tmp_path):
    index = ContentIndex(spark, str(tmp_path / "index"), buckets=4)
    index.add(_frame(spark, _content(2, 50, [5, 9])))
    plan = _plan(spark, index.near_dup_urls(_frame(spark, _content(3, 5, [5, 9]))))
    # formatted plans list each scan's subtree: the stored side goes from its bucketed scan to the join
    tree = plan.split("\n\n(1)")[0].splitlines()
    scan = next(i for i, line in enumerate(tree) if "Scan parquet" in line and "tidings_" in line)
    depth = tree[scan].index("+-") if "+-" in tree[scan] else tree[scan].index(":-")
    above = []
    for line in reversed(tree[:scan]):
        at = line.index("+-") if "+-" in line else (line.index(":-") if ":-" in line else 0)
        if at < depth:
            above.append(line.split("-")[-1].strip())
            depth = at
        if "Join" in line and at <= depth:
            break
    assert "SortMergeJoin" in above[-1] and not any("Exchange" in x for x in above), above
    assert "Bucketed: true" in plan


def test_a_batch_writes_only_its_own_rows_and_can_be_replayed(spark, tmp_path):
    index = ContentIndex(spark, str(tmp_path / "index"), buckets=4)
    index.add(_frame(spark, [(1, "a", 77)]), 0)
    before = _files(tmp_path / "index")
    batch = _frame(spark, [(2, "b", 77 ^ 1), (3, "c", _signed(0xF0F0F0F0F0F0F0F0))])
    dups = index.near_dup_urls(batch, before=1)
    assert [r["url"] for r in dups.collect()] == ["b"]
    index.add(batch.where("url = 'c'"), 1)
    after = _files(tmp_path / "index")
    assert before.items() <= after.items() and len(after) - len(before) <= 5
    # the batch once more: its own rows don't count as stored
    assert [r["url"] for r in index.near_dup_urls(batch, before=1).collect()] == ["b"]
    index.add(batch.where("url = 'c'"), 1)
    assert sorted(r["url"] for r in index.near_dup_urls(batch, before=2).collect()) == ["b", "c"]
    # another session's view: opened again by its path
    assert ContentIndex(spark, str(tmp_path / "index"), buckets=4).near_dup_urls(batch, before=2).count() == 2


def test_small_lookups_read_touched_buckets(spark, tmp_path):
    index = ContentIndex(spark, str(tmp_path / "index"), buckets=16)
    index.add(_frame(spark, _content(2, 300, [random.Random(3).getrandbits(64) for _ in range(40)])))
    plan = _plan(spark, index.unknown_urls(_frame(spark, [(1, "u5", 0)])))
    assert "SelectedBucketsCount: 1 out of 16" in plan


def _urls(spark, n, hosts):
    df = spark.range(n).select(F.col("id"), F.concat(F.lit("https://"), (F.col("id") % hosts).cast("string"), F.lit("/"), F.col("id").cast("string")).alias("url"),
                               F.concat(F.lit("h"), (F.col("id") % hosts).cast("string")).alias("hostname"), F.lit("url").alias("kind"),
                               F.lit(K.CRAWL_QUEUED).alias("crawl_state"), F.col("id").alias("sequence"))
    return df.withColumn("next_crawl_at", ts_lit(AS_OF))


def test_claiming_one_host_rewrites_one_bucket(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "urls"), "hostname", 16)
    urls = _urls(spark, 400, 40)
    table.write(urls)
    before = _files(table.path)
    request = urls.where("hostname = 'h7'").select("hostname", "id")
    assert "PartitionFilters" in _plan(spark, table.rows(request)) and len(table.touched(request)) == 1
    new = table.update(request, lambda t: FR.claim_urls(t, request, AS_OF))
    after = _files(table.path)
    changed = {os.path.basename(os.path.dirname(f)) for f, _ in set(before.items()) ^ set(after.items())}
    assert changed == {f"bucket={table.touched(request)[0]}"}
    assert new.where("applied").count() == 10
    whole = FR.claim_urls(urls, request, AS_OF).drop("applied")
    columns = sorted(whole.columns)
    assert sorted(map(str, table.rows().select(columns).collect())) == sorted(map(str, whole.select(columns).collect()))


def test_positions_with_one_host_holding_nearly_all(spark):
    r = random.Random(2)
    rows = [(i, "hot" if r.random() < 0.9 else r.choice(["a", "b", None]), r.randint(0, 1), r.randint(0, 300)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, hostname string, branch int, sequence long").repartition(7)
    got = {x["id"]: x["pos"] for x in positions(df, ["hostname"], ["branch", "sequence", "id"]).collect()}
    want = {}
    for host in {x[1] for x in rows}:
        for pos, x in enumerate(sorted((x for x in rows if x[1] == host), key=lambda x: (x[2], x[3], x[0])), 1):
            want[x[0]] = pos
    assert got == want
    assert positions(df.limit(0), ["hostname"], ["branch"]).count() == 0


def test_back_queue_has_no_window_by_host(spark):
    front = _urls(spark, 50, 3).withColumn("branch", F.lit(1))
    plan = _plan(spark, FR.back_queue(front))
    assert "Window" not in plan and "row_number" not in plan
