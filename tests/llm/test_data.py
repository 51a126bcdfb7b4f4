"""Operators 4, 6 and 7 and the pipeline."""

import glob
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

from sigspark.llm import chat, exact_dedup, mixing, ngram_join, token_files
from sigspark.llm.common import new_path
from tests.llm.conftest import TEXTS
from tests.llm.test_dedup import WORD, brute_classes

BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_token_files(docs, no_docs, shipped):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(BPE)
    path = new_path(shipped, "test-tokens")
    token_files.write_tokens(docs, path, BPE)
    got = {r["doc_id"]: r["ids"] for r in token_files.read_tokens(shipped, path).collect()}
    for i, t, *_ in TEXTS:
        assert got[i] == tok.encode(t or "", add_special_tokens=False).ids + [0]
    rows = token_files.digests(token_files.read_tokens(shipped, path))
    lengths = token_files.read_tokens(shipped, path, "part", "n_tokens")
    rows = token_files.with_starts(rows, lengths, "doc_id").collect()
    total = 0
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["start"])):
        ids = np.array(got[r["doc_id"]], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (total, len(ids), zlib.crc32(ids.tobytes()))
        total += len(ids)
    some = token_files.read_tokens(shipped, path, "doc_id", first_id=5, last_id=7)
    assert sorted(r[0] for r in some.collect()) == [5, 6, 7]
    empty = new_path(shipped, "test-tokens")
    token_files.write_tokens(no_docs, empty, BPE)
    assert token_files.read_tokens(shipped, empty).count() == 0


def test_token_file_layout(shipped):
    path = new_path(shipped, "test-tokens")
    token_files.write_tokens(shipped.read.parquet("/root/testdata/sf0.01/documents.parquet"), path, BPE)
    for name in glob.glob(f"{path.removeprefix('file://')}/*.parquet"):
        group = pq.ParquetFile(name).metadata.row_group(0)
        cols = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
        lists = next(c for n, c in cols.items() if n.startswith("ids"))
        assert any("DICTIONARY" in e for e in lists.encodings)
        assert "DELTA_BINARY_PACKED" in cols["doc_id"].encodings
        assert cols["doc_id"].has_column_index and cols["doc_id"].has_offset_index


def render(turns):
    return "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in turns)


def test_chat(shipped, monkeypatch):
    a = [("user", "hi"), ("assistant", "hello"), ("user", "bye")]
    convs = {1: a[:1], 2: a[:2], 3: a, 4: a, 5: [("user", "hi"), ("assistant", "other")], 6: [(None, None)],
             7: [("user", "")], 8: [("user", f"t{k}") for k in range(30)], 9: [("user", f"t{k}") for k in range(17)],
             None: [("user", "no id")]}
    rows = [(c, 10 * k, r, t, "x") for c, x in convs.items() for k, (r, t) in enumerate(x)]
    rows += [(1, 0, "user", "hi", "x")]  # a repeated row
    df = shipped.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string").repartition(3)
    for chunk in (1024, 4, 50):
        monkeypatch.setattr(chat, "CHUNK", chunk)
        got = chat.chat_format(df).collect()
        whole = {}
        for r in sorted(got, key=lambda r: r["part"]):
            whole[r["conv"]] = whole.get(r["conv"], "") + r["rendered"]
        assert whole == {c: render(convs[c]) for c in (3, 5, 6, 7, 8, None)}
        assert {r["conv"]: r["n_copies"] for r in got}[3] == 2
    assert chat.chat_format(df.where("false")).count() == 0


def water(sizes, weights, times=3):
    """Targets by sharing the excess again until none is above."""
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = total - sum(target[k] for k in range(len(sizes)) if k not in open_)
        share = {k: left * weights[k] / sum(weights[j] for j in open_) for k in open_}
        full = {k for k in open_ if share[k] > times * sizes[k]}
        for k in open_:
            target[k] = times * sizes[k] if k in full else share[k]
        if not full:
            return target
        open_ -= full
    return target


@pytest.mark.parametrize("block", [7, 256])
def test_mixing(docs, no_docs, block, monkeypatch):
    monkeypatch.setattr(mixing, "ROW_BUCKET", 2)
    monkeypatch.setattr(mixing, "SLOT_BUCKET", 16)
    sizes, goal, spans = mixing.schedule(docs, block=block)
    names = sorted({s for *_, s in TEXTS if s is not None}) + [None]
    size = [sum(len(WORD.findall(t or "")) for _, t, _, s in TEXTS if s == n) for n in names]
    want = water(size, [k % 3 + 1 for k in range(len(names))])
    got = {r["source"]: r for r in goal.collect()}
    assert [got[n]["source_size"] for n in names] == size
    assert np.allclose([got[n]["target"] for n in names], want)
    rows = spans.collect()
    taken, per_slot = {}, {}
    for r in rows:
        taken[r["source_no"]] = taken.get(r["source_no"], 0) + r["words"]
        per_slot.setdefault(r["slot"], []).append((r["source_no"], r["words"]))
    assert [taken.get(k, 0) for k in range(len(names))] == [int(x + 0.5) for x in want]
    assert all(len({s for s, _ in x}) == 1 and sum(n for _, n in x) <= block for x in per_slot.values())
    _, _, again = mixing.schedule(docs.repartition(5), block=block)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, rows), key=str)
    sizes, goal, spans = mixing.schedule(no_docs)
    assert sizes.count() == 0 and goal.count() == 0 and spans.count() == 0


def test_schedule_spreads_sources(shipped):
    """Every stretch of the schedule holds each source near its share."""
    df = shipped.createDataFrame([(k, "w " * 50, "abc"[k % 3]) for k in range(300)],
                                 "doc_id long, text string, source string")
    _, goal, spans = mixing.schedule(df, block=10)
    share = {r["source_no"]: r["target"] / 15000 for r in goal.collect()}
    slots = dict((r["slot"], r["source_no"]) for r in spans.collect())
    order = [slots[k] for k in sorted(slots)]
    for lo in range(0, len(order) - 100, 100):
        part = order[lo:lo + 100]
        assert all(abs(part.count(s) - 100 * x) <= 6 for s, x in share.items())


def accepted(rows):
    """Which of the rows (text, lang) have a letter and a set of languages that
    pays its penalties against no language: every subset, mixtures to the end."""
    def grams(text):
        raw = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in b" " + (text or "").encode() + b" ")
        keys = [int.from_bytes(raw[k:k + 3], "big") for k in range(len(raw) - 2)]
        return [(k * 0x9E3779B1 % 2 ** 32) >> 16 for k in keys if k != 0x202020]

    langs = sorted({x for t, x in rows if x is not None and t is not None})
    n = np.zeros((65536, len(langs)))
    for t, x in rows:
        if x is not None and t is not None:
            np.add.at(n[:, langs.index(x)], grams(t), 1)
    by_count, by_type = (n + 0.05) / (n.sum(0) + 0.05 * 65536), (n > 0) / np.maximum((n > 0).sum(0), 1)
    p = np.column_stack([np.full(65536, 1 / 65536), (by_count + by_type) / 2])
    out = []
    for t, _ in rows:
        at, c = np.unique(np.array(grams(t), np.int64), return_counts=True)
        best = -np.inf
        for bits in range(1, 2 ** len(langs)):
            use = [0] + [k + 1 for k in range(len(langs)) if bits >> k & 1]
            pi = np.full(len(use), 1 / len(use))
            for _ in range(300):
                r = p[at][:, use] * pi
                new = (c / r.sum(1)) @ r / max(c.sum(), 1)
                if np.abs(new - pi).max() < 1e-7:
                    break
                pi = new
            like = float(c @ np.log(p[at][:, use] @ pi)) if len(at) else -np.inf
            best = max(best, like - 3 * np.log(c.sum() + 1) * (len(use) - 1) + c.sum() * np.log(65536) if len(at) else -np.inf)
        out.append(bool(re.search(r"[^\W\d_]", t or "")) and best > 0)
    return out


def test_language_stage(shipped):
    """Short, multilingual and partly foreign texts stay; texts without any of the languages go."""
    import corpus_pipeline as P
    rng = np.random.default_rng(4)
    sample = [(r["text"], r["lang"]) for r in shipped.read.parquet("/root/testdata/sf0.001/documents.parquet")
              .select("text", "lang").collect() if r["text"]]
    by = {x: [t for t, y in sample if y == x] for x in sorted({y for _, y in sample if y})}
    word = lambda k: "".join(rng.choice(list("qxzjkvw"), k))
    parts = [t[0][:200] for t in by.values()]
    kept = [" ".join(parts), parts[0] + " ".join(word(7) for _ in range(100)), *[p.split()[0] + " " + p.split()[1] for p in parts],
            " | ".join(p[:60] for p in parts) + " 0x1f 0x2e"]
    gone = [" ".join(word(7) for _ in range(60)), "\u4e00\u4e8c\u4e09" * 30, "7 8 9", "\u0416" * 200]
    rows = sample + [(t, None) for t in kept + gone]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = shipped.createDataFrame([(k, t, x, "s", len(t)) for k, (t, x) in enumerate(rows)], schema)
    got = {r["doc_id"] for r in P.language_id(shipped, docs, "").collect()}
    want = accepted(rows)
    assert got == {k for k, w in enumerate(want) if w}
    base = len(sample)
    assert got >= set(range(base, base + len(kept))) and not got & set(range(base + len(kept), len(rows)))


def test_pipeline_stages(shipped):
    """Each stage against brute force over the rows that it was given."""
    import corpus_pipeline as P
    sf = "/root/testdata/sf0.001"
    docs = shipped.read.parquet(f"{sf}/documents.parquet")
    for name, stage in P.STAGES:
        before = docs.collect()
        path = new_path(shipped, f"test-{name}")
        stage(shipped, docs, sf).write.parquet(path)
        docs = shipped.read.parquet(path)
        after = docs.collect()
        if name != "sentencepiece":
            assert docs.columns == P.COLUMNS
        ids = sorted(r["doc_id"] for r in after)
        if name == "language_id":
            want = accepted([(r["text"], r["lang"]) for r in before])
            assert ids == sorted(r["doc_id"] for r, w in zip(before, want) if w)
        elif name == "exact_dedup":
            best = {}
            for r in before:
                key = hashlib.md5(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "").encode()).digest()
                rank = (-len(r["text"] or ""), r["doc_id"])
                best[key] = min(best.get(key, rank), rank)
            assert ids == sorted(i for _, i in best.values())
        elif name == "ngram_join":
            classes = brute_classes([(r["doc_id"], r["text"]) for r in before])
            assert ids == sorted(i for i, (c, _) in classes.items() if i == c)
        elif name == "mixing":
            size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in before}
            names = sorted({r["source"] for r in before if r["source"] is not None})
            per = [sum(size[r["doc_id"]] for r in before if r["source"] == n) for n in names]
            goal = dict(zip(names, water(per, [k % 3 + 1 for k in range(len(names))])))
            for n in names:
                got = sum(size[r["doc_id"]] for r in after if r["source"] == n)
                assert abs(got - goal[n]) <= max(size[r["doc_id"]] for r in before if r["source"] == n) / 2 + 1
            assert max(ids.count(i) for i in set(ids)) <= 3
        else:
            import sentencepiece
            sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            assert ids == sorted(r["doc_id"] for r in before)
            assert all(sp.decode(list(r["pieces"])) == (r["text"] or "") for r in after)
    assert sorted(map(str, P.run(shipped, sf).collect())) == sorted(map(str, after))


def test_pipeline_empty(shipped):
    import corpus_pipeline as P
    docs = shipped.read.parquet("/root/testdata/sf0.001/documents.parquet").where("false")
    for name, stage in P.STAGES:
        docs = stage(shipped, docs, "")
        path = new_path(shipped, f"test-empty-{name}")
        docs.write.parquet(path)
        docs = shipped.read.parquet(path)
        assert docs.count() == 0


def test_pipeline_cases(docs, shipped):
    """Null ids, nulls in every column, long texts, repeats and clashing columns pass all stages."""
    import corpus_pipeline as P
    seen, rows = {}, docs
    for name, stage in P.STAGES:
        path = new_path(shipped, f"test-cases-{name}")
        stage(shipped, rows, "").write.parquet(path)
        rows = shipped.read.parquet(path)
        seen[name] = [r["doc_id"] for r in rows.collect()]
    want = accepted([(t, x) for _, t, x, _ in TEXTS])
    assert set(seen["language_id"]) == {r[0] for r, w in zip(TEXTS, want) if w}
    assert set(seen["language_id"]) >= {1, 2, 3, 7, 9, 10, 12, 13, 14, None}  # row 10 is nearly all that "de" has learned
    assert set(seen["language_id"]) - set(seen["exact_dedup"]) == {1}  # the longest of equal texts stays
    assert set(seen["ngram_join"]) <= set(seen["exact_dedup"]) and {2, 7, None} <= set(seen["ngram_join"])
    assert seen["mixing"] and max(seen["mixing"].count(i) for i in seen["mixing"]) <= 6
    assert sorted(map(str, seen["sentencepiece"])) == sorted(map(str, seen["mixing"]))
    assert rows.columns == P.COLUMNS + ["pieces"]


def test_pipeline_dedup_drops_single_rows(shipped):
    """Repeated rows, rows without an id and ids with two texts, in both dedup stages."""
    import corpus_pipeline as P
    long = [" ".join(f"{c}{k}" for k in range(60)) for c in "abcdefg"]
    near = {t: t.replace(t.split()[30], "other") for t in long}
    same = [(1, long[0])] * 3 + [(None, long[1])] * 4 + [(2, long[2]), (None, long[2]), (3, long[2]), (3, long[3])]
    close = [(4, long[4]), (4, near[long[4]]), (None, long[5]), (None, near[long[5]]),
             (6, long[6]), (7, near[long[6]]), (7, "a text of its own")]
    one = lambda x: [(i, t, None, "s", len(t)) for i, t in x]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    ids = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    got = P.exact_duplicates(shipped, shipped.createDataFrame(one(same + close), schema).repartition(3), "")
    want = [(1, long[0]), (None, long[1]), (2, long[2]), (3, long[3])]
    assert ids(got) == sorted(want + close, key=str)
    got = ids(P.near_duplicates(shipped, shipped.createDataFrame(one(same + close), schema).repartition(3), ""))
    assert len(got) == 8 and {i for i, _ in got} == {1, None, 2, 3, 4, 6, 7}
    assert set(want) | {(6, long[6]), (7, "a text of its own")} <= set(got)


def test_pipeline_mix_takes_single_rows(shipped, monkeypatch):
    """Rows without an id, ids with several texts and equal rows each take their own part of the mix."""
    import corpus_pipeline as P
    monkeypatch.setattr(mixing, "ROW_BUCKET", 4)
    rows = [(None, f"n{k} " * (k + 1), None, "a", k) for k in range(30)]
    rows += [(5, f"r{k} " * (k + 1), None, "a", k) for k in range(30)] + [(9, "equal row", None, "b", 0)] * 20
    rows += [(100 + k, f"u{k} " * 7, None, "bc"[k % 2], k) for k in range(40)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = shipped.createDataFrame(rows, schema).repartition(3)
    sizes, goal, spans = mixing.schedule(docs)
    assert sizes.count() == len(rows) == sizes.select(*mixing.KEY).distinct().count()
    quota = {r["source"]: int(r["target"] + 0.5) for r in goal.collect()}
    got = P.mix(shipped, docs, "").collect()
    times, given = {}, {}
    for r in got:
        times[r["doc_id"], r["text"]] = times.get((r["doc_id"], r["text"]), 0) + 1
    for i, t, *_ in rows:
        given[i, t] = given.get((i, t), 0) + 1
    assert all(n <= 3 * given[k] for k, n in times.items())
    for source, want in quota.items():  # the last document alone may be cut
        have = sum(len(r["text"].split()) for r in got if r["source"] == source)
        assert abs(have - want) <= 15
    key = mixing.order_key("id", mixing.F.lit(0), 7)
    assert sizes.where("id is null or id = 5").select(key).distinct().count() == 60
    again = mixing.schedule(docs.repartition(5))[2].collect()
    assert sorted(map(str, again)) == sorted(map(str, spans.collect()))


def test_pipeline_mix_writes_slot_order(shipped):
    """Each file of the mix has the order of the first slots of its copies."""
    import corpus_pipeline as P
    docs = shipped.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = new_path(shipped, "test-order")
    P.mix(shipped, docs, "").write.parquet(path)
    first = {}
    for r in mixing.schedule(docs)[2].collect():
        words, slot = first.get((r["id"], r["epoch"]), (0, r["slot"]))
        first[r["id"], r["epoch"]] = words + r["words"], min(slot, r["slot"])
    size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in docs.collect()}
    slots = {}
    for (i, _), (words, slot) in first.items():
        if 2 * words >= size[i]:
            slots.setdefault(i, []).append(slot)
    seen = {}
    for f in glob.glob(f"{path.removeprefix('file://')}/*.parquet"):
        got = pq.read_table(f).column("doc_id").to_pylist()
        left = {i: sorted(slots[i]) for i in set(got)}  # copies of a row lie in one file
        order = [left[i].pop(0) for i in got]
        assert order == sorted(order) and not any(left.values())
        seen |= dict.fromkeys(got)
    assert set(seen) == set(slots)


def test_operators_agree_with_stage_order():
    import corpus_pipeline as P
    assert [n for n, _ in P.STAGES] == ["language_id", "exact_dedup", "ngram_join", "mixing", "sentencepiece"]
    assert exact_dedup.exact_dedup and ngram_join.jaccard_join
