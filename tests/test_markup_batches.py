"""HTML texts go through Python a slice of a batch at a time."""

import pyarrow as pa

from hirelens.functions.markup import map_texts


def test_texts_are_changed_slice_by_slice_and_nulls_stay():
    texts = [None, "a", "", *map(str, range(7)), None]
    for rows in (1, 3, 100):
        assert map_texts(pa.array(texts), lambda text: text + "!", rows).to_pylist() == [None if t is None else t + "!" for t in texts]
    assert map_texts(pa.nulls(3, pa.string()), str.upper).to_pylist() == [None] * 3
    assert map_texts(pa.array([], pa.string()), str.upper).to_pylist() == []
