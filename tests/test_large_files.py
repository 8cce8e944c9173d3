"""Files are hashed piece by piece."""

import hashlib

from tidemark.operators import pit


def test_hashes_do_not_hold_a_file(spark, tmp_path):
    for name, raw in (("a.bin", b"x" * 3_000_000), ("b c%20d.bin", b"y"), ("sub/e=1/f.bin", bytes(range(256)))):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(raw)
    out = pit.file_hashes(spark, str(tmp_path))
    # the content column is not read
    assert "content" not in out._jdf.queryExecution().executedPlan().toString()
    want = {str(p.relative_to(tmp_path)): (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in tmp_path.rglob("*.bin")}
    assert {r["name"]: (r["length"], r["sha256"]) for r in out.collect()} == want and len(want) == 3
