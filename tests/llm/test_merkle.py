"""The manifest against SQL, and against a tree built by a loop over odd rows."""

import sys
import zlib
from collections import defaultdict
from hashlib import sha256

import edge_rows

sys.path.insert(0, edge_rows.__file__.rsplit("/", 2)[0])

from oracle import check  # noqa: E402

from sheetlens.llm import merkle as M  # noqa: E402
from sheetlens.llm.common import crc_mod  # noqa: E402
from sheetlens.llm.queries import ORACLE_SQL, op12_merkle_manifest  # noqa: E402

H = lambda t: sha256(t.encode()).hexdigest()


def written(*values):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, fanout):
    """Root, and for each node its proof, one list of siblings a level, with its place there."""
    proofs, at, groups = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(groups) > 1:
        runs = [groups[i : i + fanout] for i in range(0, len(groups), fanout)]
        for k, a in enumerate(at):
            proofs[k].append((a % fanout, [x for j, x in enumerate(runs[a // fanout]) if j != a % fanout]))
            at[k] = a // fanout
        groups = [H("".join(r)) for r in runs]
    return groups[0], proofs


def brute(rows, fanout):
    by = defaultdict(list)
    for i, text, lang, source, n in rows:
        tampered = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        other = written(i, source, lang, n, tampered if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else text)
        by[source].append(((i is not None, i or 0), written(i, source, lang, n, text), other, i))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    lower = {}
    for s in names:
        by[s].sort(key=lambda x: x[:2])
        lower[s] = tree([x[1] for x in by[s]], fanout)
    root, upper = tree([lower[s][0] for s in names], fanout) if names else (None, [])
    out = []
    for k, s in enumerate(names):
        for (_, leaf, other, i), proof in zip(by[s], lower[s][1], strict=True):
            steps, cur = proof + upper[k], other
            for at, sib in steps:
                cur = H("".join([*sib[:at], cur, *sib[at:]]))
            out.append((i, leaf, lower[s][0], root, H("".join(x for _, sib in steps for x in sib)), cur, cur == root))
    return sorted(out, key=str)


def found(df, **kw):
    rows = M.manifest(df, changed={"text": M.lowered("text")}, suspect=crc_mod("doc_id", 5) == 0, **kw)
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in rows.collect()), key=str)


def test_query_equals_its_sql(spark, sf01, tmp_path):
    assert check(op12_merkle_manifest(spark, sf01), ORACLE_SQL["op12_merkle_manifest"], sf01, tmp_path) > 0


def test_odd_rows(spark):
    assert found(edge_rows.documents(spark)) == brute(edge_rows.ROWS, 16)
    assert found(edge_rows.documents(spark, [])) == []
    one = [(7, "A b", "en", "src1", 3)]
    (row,) = found(edge_rows.documents(spark, one))
    assert row[1] == row[2] == row[3] and row[4] == H("")


def test_many_levels_and_a_large_source(spark):
    """Small fan-outs give many rounds; one source holds most rows, one id repeats in many equal rows, sources are many."""
    rows = [(2**62 + i, f"Text {i}", "en", "hot", i) for i in range(300)] + [(5, "Same Row", None, "hot", 1)] * 150 + [(i, None, "de", f"s{i % 40}é", None) for i in range(120)]
    for fanout, levels in ((2, 3), (3, 2), (16, 2)):
        assert found(edge_rows.documents(spark, rows), fanout=fanout, levels=levels) == brute(rows, fanout)
    got = found(edge_rows.documents(spark, rows))
    assert {True, False} == {r[6] for r in got}
    assert all((r[5] == r[3]) == r[6] for r in got)
