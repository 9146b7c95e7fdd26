"""Every query of the engine against its SQL on DuckDB, over the smallest tables, and over events
that all lie on whole hours, so on the boundaries of every grid; queries without SQL against Python."""

import glob
import math
import os
import zlib

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from meridia.plans import registry

DIR = "/root/testdata/sf0.001"
HOUR = 3600 * 10**9


def connect(folder):
    c = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.fixture(scope="module")
def con():
    return connect(DIR)


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v if v is None or isinstance(v, (bool, int, str)) else str(v)


def rows(names, data):
    order = sorted(names)
    return sorted((tuple(plain(r[list(names).index(n)]) for n in order) for r in data), key=repr)


def etags(con):
    for page, html in con.sql("select page_id, html from pages").fetchall():
        body = (html or "").encode()
        tag = f'"{zlib.crc32(body):08x}-{len(body):x}{"-gz" if page % 2 else ""}"'
        header = [tag, '"a-1" , W/' + tag, "*", '"a-1"', None][page % 5]
        yield page, tag, header is not None and any(x.strip() == "*" or x.strip().removeprefix("W/") == tag for x in header.split(","))


def planned(con):
    """Parts as they would be planned if all were known, for streams whose units can end anywhere, replayed unit by unit."""
    from meridia.operators import folds

    most, streams = 20 * HOUR, {}
    for r in con.sql("select user_id, epoch_us(ts) * 1000, event_type, cast(round(value * 100) as bigint) from events order by 1, 2, event_id").fetchall():
        streams.setdefault(r[0], []).append(r)
    for stream, units in streams.items():
        segments = {}
        for _, t, kind, size in units[:-1]:
            segments.setdefault(t // (96 * HOUR), []).append((t, HOUR + size % 3 * HOUR, kind == "purchase", kind != "click" or stream % 2 == 0))
        for segment in sorted(segments):
            held, part, shown, bound = [], 0, None, False
            failed = False
            for i, unit in enumerate([*segments[segment], None]):
                if unit is not None:
                    held.append(unit)
                    bound |= not unit[3]
                while held and not failed:
                    shape = [(u[1], u[2], u[3]) for u in held]
                    runs = folds.eager(shape, most) or folds.partition(shape, most)
                    if runs is None:
                        yield stream, segment, part, held[0][0], held[0][1], len(held), "no_partition"
                        failed = True
                        break
                    if unit is None:
                        cut = runs[0]
                    elif len(runs) < 2:
                        shown = None
                        break
                    else:
                        after = held[runs[0] : runs[0] + runs[1]]
                        whole = sum(u[1] for u in after) * 100 >= most * 85 or any(u[2] for u in after)
                        sure = after[-1][3] and whole if bound else (runs[0] == 1 and held[0][1] + held[1][1] > most) or all(u[2] for u in held) or (shown is not None and len(held) > shown)
                        if not sure and sum(u[1] for u in held) <= 2 * most:
                            shown = len(held)
                            break
                        cut = runs[0]
                    if unit is None:
                        for n in runs:
                            yield stream, segment, part, held[0][0], sum(u[1] for u in held[:n]), n, None
                            held, part = held[n:], part + 1
                        break
                    yield stream, segment, part, held[0][0], sum(u[1] for u in held[:cut]), cut, None
                    held, part, shown = held[cut:], part + 1, None
                if failed:
                    break
            if failed:
                break


#: queries that SQL cannot express: (columns, rows by Python)
TWINS = {
    "fn13_etag": (["page_id", "tag", "not_modified"], etags),
    "str15_planned": (["stream", "segment", "part", "start", "size", "units", "error"], planned),
}


def check(spark, con, folder, name):
    df = registry.queries()[name](spark, folder)
    got = rows(df.columns, df.collect())
    if name in TWINS:
        columns, twin = TWINS[name]
        want = rows(columns, list(twin(con)))
    else:
        sql = registry.oracle_sql()[name]  # a query has SQL or a twin
        found = con.sql(sql)
        columns, want = found.columns, rows(found.columns, found.fetchall())
    assert sorted(columns) == sorted(df.columns)
    assert got == want


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    check(spark, con, DIR, name)


@pytest.fixture(scope="module")
def on_the_hour(tmp_path_factory):
    """The tables with events at whole hours, every third at a whole half day, many at one time, and after 2016."""
    folder = tmp_path_factory.mktemp("hours")
    for p in glob.glob(f"{DIR}/*.parquet"):
        if not p.endswith("/events.parquet"):
            os.symlink(p, folder / os.path.basename(p))
    e = pq.read_table(f"{DIR}/events.parquet")
    micros = e.column("ts").cast(pa.int64()).to_pylist()
    hour = 3600 * 10**6
    at = [x // hour * hour if i % 3 else x // (12 * hour) * 12 * hour for i, x in enumerate(micros)]
    seen, unique = set(), []
    for user, x in zip(e.column("user_id").to_pylist(), at):  # a stream's times stay distinct
        while (user, x) in seen:
            x += hour
        seen.add((user, x))
        unique.append(x)
    e = e.set_column(e.schema.get_field_index("ts"), "ts", pa.array(unique, pa.int64()).cast(pa.timestamp("us")))
    pq.write_table(e, folder / "events.parquet")
    return str(folder)


GRIDS = """join2_common_keyframes join3_covering join4_cut join5_band join6_gap_split str11_grid str12_coordinated_cut str13_missed str17_sealed_windows str18_late_cues str21_guards pq2_rate
pq3_sum_rate evt6_retry snk2_recorder src7_bounded_batch ret14_cache snk3_path win3_interval_union win15_ceiling win23_reconstruct ret1_sliding_window ret5_discontinuity ret12_average_bitrate
pl1_media_playlist pl2_iframe_playlist pl5_program_date str2_density str3_floor str4_drift str6_gaps str8_hole_budget str9_episodes str27_blocking adm2_address sort5_lru sup13_part_clock sup31_maintenance
ret8_expiry str10_boundary pq14_server_errors""".split()


@pytest.mark.parametrize("name", GRIDS)
def test_query_on_boundaries(spark, on_the_hour, name):
    check(spark, connect(on_the_hour), on_the_hour, name)


def test_hole_sums_beyond_a_long(spark, tmp_path):
    """Two streams with a hole of 229 years each: together beyond 64 bits of nanoseconds, where the SQL's cast fails too."""
    at = [31_536_000_000_123, 7_258_118_400_000_000]
    events = [(2 * s + i, t, s, "view", 1.0, "{}") for s in range(2) for i, t in enumerate(at)]
    e = pa.table(dict(zip(["event_id", "ts", "user_id", "event_type", "value", "props"], map(list, zip(*events)))))
    pq.write_table(e.set_column(1, "ts", e.column("ts").cast(pa.timestamp("us"))), tmp_path / "events.parquet")
    got = [tuple(r) for r in registry.queries()["agg11_compensation"](spark, str(tmp_path)).collect()]
    assert 2 * (at[1] - at[0]) * 1000 >= 2**63
    assert [(k, ra, n, int(missing)) for k, ra, n, missing in got] == [("view", True, 2, 2 * (at[1] - at[0]) * 1000)]
    assert dict(registry.queries()["agg11_compensation"](spark, DIR).dtypes)["missing"] == "bigint"
