import numpy as np
import pyarrow as pa

from lociweave.llm.ngram_join import _product


def test_rows_passed_over_come_back_when_another_component_grows_larger():
    # Links at 15 percent: 0-{1..5}, 6-{7..12}, 3-9. Row 0 makes the largest
    # component, then row 6 a larger one; 3-9 joins two rows passed over.
    sets = [list(range(100)), *[list(range(16 * k, 16 * k + 16)) for k in range(5)], list(range(200, 300)), *[list(range(200 + 16 * k, 216 + 16 * k)) for k in range(6)]]
    shared = list(range(900, 906))
    sets[3] += shared
    sets[9] += shared
    table = pa.table({"id": range(13), "n": [len(s) for s in sets], "entries": [np.array(s, "<u8").tobytes() for s in sets], "component": range(13)})
    got = _product(table, 15)
    links = {frozenset(p) for p in zip(got["src"].to_pylist(), got["dst"].to_pylist(), strict=True)}
    assert links == {frozenset(p) for p in [*((0, k) for k in range(1, 6)), *((6, k) for k in range(7, 13)), (3, 9)]}
