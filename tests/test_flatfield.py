"""The flat field of large images against numpy's SVD; models at rest."""

import numpy as np
import pyarrow as pa
import pytest

from grainflow.operators.flatfield import FlatField


def images(spark, x, tmp_path, name):
    import pyarrow.parquet as pq

    ids = pa.array(np.arange(len(x)))
    pq.write_table(pa.table({"id": ids, "px": pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))}), f"{tmp_path}/{name}.parquet", row_group_size=8)
    return spark.read.parquet(f"file://{tmp_path}/{name}.parquet").repartition(4)


def flats(field, df, **kw):
    return np.array([r.flat for r in field.flattened(df, "px", **kw).select("id", "flat").orderBy("id").collect()])


def test_images_of_100_000_pixels(spark, tmp_path):
    """Images of 250 x 400 pixels and rank 5 (one mode is the mean) come back; the saved model gives the same field, also where it is read block by block."""
    rng = np.random.default_rng(1)
    shapes = np.stack([np.outer(np.cos(np.linspace(0, k + 1, 250)), np.sin(np.linspace(0.1, k + 2, 400))).ravel() for k in range(4)])
    x = rng.random((24, 4)) @ shapes * [[5.0]] + 3.0
    df = images(spark, x, tmp_path, "large")
    field = FlatField(df, "px", 5, centre="all", rounds=1, extra=4)
    mean = x.mean()
    assert field.pixels == 100_000 and field.images == 24
    u = np.linalg.svd((x - mean).T, full_matrices=False)
    assert np.allclose(field.strength, u[1][:5], rtol=1e-8)
    got, want = flats(field, df), mean + x @ u[0][:, :5] @ u[0][:, :5].T
    assert np.abs(got - want).max() < 1e-6
    field.save(f"file://{tmp_path}/model")
    again = FlatField.read(spark, f"file://{tmp_path}/model")
    assert np.array_equal(flats(again, df), got) and again.rank == field.rank
    again.held = 1000
    assert np.allclose(flats(again, df), got)
    with pytest.raises(Exception, match="(?i)exists"):
        field.save(f"file://{tmp_path}/model")


def test_modes_of_a_full_matrix(spark, tmp_path):
    """A decaying spectrum: the first modes are numpy's; blocks that don't divide the image, and several passes, give the same."""
    rng = np.random.default_rng(2)
    u, v = np.linalg.qr(rng.normal(size=(120, 90)))[0], np.linalg.qr(rng.normal(size=(90, 90)))[0]
    x = (u * 10.0 * 0.5 ** np.arange(90)) @ v.T + rng.random(90) + 2
    df = images(spark, x, tmp_path, "full")
    want_s, want_v = np.linalg.svd(x - x.mean(0), full_matrices=False)[1:]
    for block, held in ((4096, 1 << 25), (32, 32 * 13)):
        field = FlatField(df, "px", 3, block=block, held=held)
        assert np.allclose(field.strength, want_s[:3], rtol=1e-6)
        modes = np.concatenate([np.array(r.vectors).reshape(-1, 3) for r in field.modes().orderBy("block").collect()])
        assert np.allclose(np.abs(modes.T @ want_v[:3].T), np.eye(3), atol=1e-5) and np.allclose(modes.T @ modes, np.eye(3), atol=1e-9)
        got = flats(field, df, rank=2)
        assert np.allclose(got, x.mean(0) + x @ want_v[:2].T @ want_v[:2], atol=1e-4)


def test_edges(spark, tmp_path):
    """Images of rank 0, one image, images of several sizes, none, other columns, pixels that the field doesn't reach."""
    same = images(spark, np.full((5, 7), 2.0), tmp_path, "same")
    assert np.allclose(flats(FlatField(same, "px", 2), same), 2.0)
    one = images(spark, np.arange(1.0, 8.0)[None], tmp_path, "one")
    field = FlatField(one, "px", 2, centre="all")
    assert np.allclose(flats(field, one)[0] - 4, np.arange(1.0, 8.0) @ (np.arange(-3.0, 4) / np.sqrt(28)) * (np.arange(-3.0, 4) / np.sqrt(28)))
    two = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id int, px array<double>")
    with pytest.raises(ValueError, match="one size"):
        FlatField(two, "px", 1)
    with pytest.raises(ValueError, match="no images"):
        FlatField(two.limit(0), "px", 1)
    with pytest.raises(ValueError):
        FlatField(two, "px", 1, centre="mean")
