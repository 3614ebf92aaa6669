"""Every registered query with SQL against DuckDB, at the smallest size."""

import os

import duckdb
import pandas as pd
import pytest

from mosaiq.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return None
        if isinstance(x, str):
            return x
        f = float(x)
        return round(f, 6) + 0.0

    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, db, name):
    got = registry.QUERIES[name](spark, DIR).toPandas()
    want = db.execute(registry.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def _files():
    import pyarrow.parquet as pq

    return {str(x["doc_id"]): x["text"].encode() for x in pq.read_table(f"{DIR}/documents.parquet").to_pylist() if x["text"] is not None}


def _pixels(db):
    from mosaiq.plans import relations

    return db.execute(f"SELECT * FROM ({relations.SQL['pixel']})").fetchdf()


def _yiq(rgb):
    import numpy as np

    from mosaiq.functions.color import YIQ

    return np.asarray(rgb, float) @ np.array(YIQ).T


def check_smallest_codec(got, db):
    from mosaiq.functions import codecs as K

    kinds = ("lz", "runs", "huffman4", "huffman8", "none")
    sizes = {p: {k: len(K.PACK[k](x)) for k in kinds} for p, x in _files().items()}
    assert dict(zip(got["path"], got["coded"], strict=True)) == {p: min(kinds, key=lambda k: (n[k], kinds.index(k))) for p, n in sizes.items()}


def check_guess_kinds(got, db):
    from mosaiq.sources import objects as O

    assert dict(zip(got["path"], got["kind"], strict=True)) == {p: O.guess_kind(x) for p, x in _files().items()}


def check_create_palette(got, db):
    """Sixteen different colours, darkest first, with a tenth of the error of the mean alone."""
    px = _pixels(db)
    rgb, own = _yiq(px[["r", "g", "b"]]), _yiq(got[["r", "g", "b"]])
    assert len(set(map(tuple, got[["r", "g", "b"]].to_numpy()))) == len(got) == 16 and (own[:-1, 0] <= own[1:, 0] + 1e-9).all()
    error = ((rgb[:, None] - own[None]) ** 2).sum(-1).min(1).sum()
    assert error < 0.3 * ((rgb - rgb.mean(0)) ** 2).sum()


def check_diffused(got, db):
    """Serpentine diffusion by itself, image by image."""
    import numpy as np

    from mosaiq.plans.queries import PALETTE24

    px, own = _pixels(db), _yiq([p[1:] for p in PALETTE24])
    want = {}
    for img, rows in px.groupby("img"):
        plane = {(x, y): v.copy() for x, y, v in zip(rows["x"], rows["y"], _yiq(rows[["r", "g", "b"]]), strict=True)}
        for y in range(64):
            step = 1 if y % 2 == 0 else -1
            for x in range(64)[::step]:
                if (x, y) not in plane:
                    continue
                k = int(((own - plane[x, y]) ** 2).sum(1).argmin())
                want[img, x, y], left = k, plane[x, y] - own[k]
                for at, part in (((x + step, y), 7), ((x - step, y + 1), 3), ((x, y + 1), 5), ((x + step, y + 1), 1)):
                    if at in plane:
                        plane[at] += left * part / 16
    same = [want[r.img, r.x, r.y] == r.idx for r in got.itertuples()]
    assert len(same) == len(want) and np.mean(same) > 0.999


def check_covering(got, db):
    """All opaque pixels lie in some rectangle, and no rectangle is of another size than an object has."""
    from mosaiq.functions.packed import HEIGHTS, WIDTHS

    sizes = {(w, h) for ws, hs in zip(WIDTHS, HEIGHTS, strict=True) for w, h in zip(ws, hs, strict=True)}
    assert {(r.w, r.h) for r in got.itertuples()} <= sizes
    covered = {(r.img, x, y) for r in got.itertuples() for x in range(r.x, r.x + r.w) for y in range(r.y, r.y + r.h)}
    assert all((p.img, p.x, p.y) in covered for p in _pixels(db).itertuples() if p.a >= 128)


def check_code_maps(got, db):
    """All codes of all fonts lie in the runs, no neighbours would do better as one, and no run costs more than its codes by themselves."""
    from mosaiq.operators.dedup import code_map_cost

    want = db.execute("SELECT l_suppkey AS font, l_partkey AS code FROM lineitem GROUP BY ALL").fetchdf()
    for font, own in got.sort_values("first").groupby("font"):
        codes = sorted(want[want["font"] == font]["code"])
        rows = own[["first", "last", "n", "cost"]].to_numpy().tolist()
        assert sum(r[2] for r in rows) == len(codes) and all(sum(a <= k <= z for k in codes) == n for a, z, n, _ in rows)
        assert all(cost == code_map_cost(n, z - a + 1) for a, z, n, cost in rows)
        assert all(code_map_cost(p[2] + q[2], q[1] - p[0] + 1) > p[3] + q[3] for p, q in zip(rows, rows[1:], strict=False))


def check_background(got, db):
    """A reference for each tile of each image, to at most 1,024 characters and 4 palettes."""
    tiles = {(p.img, p.img * 64 + p.y // 8 * 8 + p.x // 8) for p in _pixels(db).itertuples()}
    assert {(r.img, r.tile_no) for r in got.itertuples()} == tiles and len(got) == len(tiles)
    assert (got["raw"] // 4096).max() < 4 and (got["raw"] % 1024).max() < 64


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLE_SQL.keys()))
def test_query_without_sql(spark, db, name):
    globals()[f"check_{name}"](registry.QUERIES[name](spark, DIR).toPandas(), db)
