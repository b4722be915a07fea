"""op2, op7, op8 and the components against brute force."""

import os
import random
import time
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quirelake.llm import common, components, line_dedup, near_copies as copies, simhash, suffix_dedup
from tests.llm import data


# -- op2 ------------------------------------------------------------------------


def cut_by_hand(texts):
    """{id: (bytes, removed, spans, kept)}; texts in ascending order of id."""
    seen, out = set(), {}
    for i, t in texts:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(b[k : k + 100])
        starts = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[i] = (len(b), int(gone.sum()), starts, np.frombuffer(b, np.uint8)[~gone].tobytes())
    return out


def repeats(seed: int) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    shared = [data.paragraph(rng, 3) for _ in range(4)]
    out = []
    for i in range(60):
        parts = [data.paragraph(rng, rng.randint(1, 3))]
        for _ in range(rng.randint(0, 2)):
            passage = rng.choice(shared)
            a = rng.randint(0, len(passage) // 2)
            parts.insert(rng.randint(0, 1), passage[a : a + rng.randint(90, 300)])
        out.append((i, "é".join(parts)))
    return [*out, (60, out[3][1]), (61, out[3][1][5:]), (62, "ab" * 300), (63, "x" * 99), (64, "x" * 100), (65, "x" * 101), (66, "")]


def test_suffix_dedup_is_exact(spark, monkeypatch):
    texts = repeats(3)
    want = cut_by_hand(texts)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    for piece in (1 << 20, 512):  # whole texts, and pieces that overlap
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(df).collect()}
        assert found == want


def test_short_passage_in_every_document(spark):
    """A line of 70 bytes among unlike texts: one gram, a segment for each document."""
    rng = random.Random(7)
    line = "This line of seventy bytes stands in each and every document of them.."
    assert len(line) == 70
    new = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.randint(60, 200)))
    texts = [(i, new() + line + new()) for i in range(400)]
    # Some have more than the line in common, over the edges of its segments.
    texts += [(400 + i, new() + texts[i][1][40:-40] + new()) for i in range(0, 60, 3)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(df).collect()}
    assert found == cut_by_hand(texts)


def test_suffix_dedup_of_awkward_rows(spark):
    found = suffix_dedup.suffix_dedup(data.documents(spark)).collect()
    texts = dict(sorted((r[0], r[1] or "") for r in data.rows()))
    want = cut_by_hand(texts.items())
    assert len(found) == len(data.rows())
    assert all((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id] for r in found)
    assert suffix_dedup.suffix_dedup(data.empty(spark)).count() == 0


def shuffle_files(spark) -> set[str]:
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {x for d in folders for _, _, names in os.walk(d.getPath()) for x in names if x.startswith("shuffle_")}


def shared_tables(spark) -> set[str]:
    return set(os.listdir(common.shared_folder(spark)))


def test_suffix_dedup_leaves_only_its_spans_on_disk(spark):
    """Before the result is read, nothing that was shuffled for it is left."""
    df = spark.createDataFrame(repeats(4), "doc_id long, text string").repartition(5)
    files, tables, cleanup = shuffle_files(spark), shared_tables(spark), spark.conf.get(common.CLEANUP, None)
    found = suffix_dedup.suffix_dedup(df)
    for _ in range(50):  # files are deleted while the driver goes on
        if shuffle_files(spark) <= files:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= files
    assert [x.rsplit("-", 1)[0] for x in shared_tables(spark) - tables] == ["suffix-spans"]
    assert spark.conf.get(common.CLEANUP, None) == cleanup
    assert found.count() == found.count() == 67  # read more than once


def test_family_keeps_the_earliest():
    rng = np.random.default_rng(1)
    family, lost, all_ = suffix_dedup.Family(), 0, []
    for _ in range(40):
        n = int(rng.integers(1, 50))
        e = suffix_dedup.entries(code=rng.integers(0, 30, n), more=rng.integers(0, 10, n), doc=rng.integers(0, 1000, n), sub=0, low=rng.integers(0, 9, n), size=100, gram=0)
        all_ += list(zip((30 * e["more"] + e["code"]).tolist(), e["doc"].tolist(), e["low"].tolist()))
        lost += len(family.add(e)["code"])
    least = {}
    for code, *place in all_:
        least[code] = min(least.get(code, place), place)
    kept = family.all()
    assert {c: [d, low] for c, d, low in zip((30 * kept["more"] + kept["code"]).tolist(), kept["doc"].tolist(), kept["low"].tolist())} == least
    sizes = [len(x["code"]) for x in family.levels]
    assert all(a > b for a, b in zip(sizes, sizes[1:]))


# -- op7 ------------------------------------------------------------------------


def fingerprint_by_hand(text: str) -> int:
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_by_hand(pairs, nodes):
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b), near[b].add(a)
    out = {}
    for n in sorted(nodes):
        stack = [n] if n not in out else []
        while stack:
            x = stack.pop()
            if x not in out:
                out[x] = n
                stack += near[x]
    return out


def near_copies(seed: int) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    out = []
    for _ in range(12):
        base = data.paragraph(rng, 12).split(" ")
        for _ in range(rng.randint(1, 8)):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(data.WORDS)
            out.append(" ".join(words))
    rng.shuffle(out)
    return list(enumerate(out))


def test_near_duplicates_equal_all_pairs(spark):
    texts = near_copies(4) + [(900, ""), (901, " "), (902, "one"), (903, "one")]
    fps = {i: fingerprint_by_hand(t) for i, t in texts}
    pairs = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    want = roots_by_hand(pairs, fps)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    found = simhash.near_duplicates(df).select("doc_id", simhash.hex_of("fp").alias("f"), "component_id").collect()
    assert {r.doc_id: (r.f, r.component_id) for r in found} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    assert len(pairs) > 20


def test_keys_meet_within_three_bits():
    rng = np.random.default_rng(2)
    for x in rng.integers(0, 1 << 63, 400, dtype=np.uint64):
        y = x
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            y ^= np.uint64(1) << np.uint64(b)
        row, key = simhash.keys_of(np.array([x, y]))
        assert set(key[row == 0]) & set(key[row == 1])


def test_dense_runs_stay_connected():
    rng = np.random.default_rng(3)
    fps = np.array([7 ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (200, 2))], np.uint64)
    links = simhash.run_links(np.zeros(len(fps), np.int32), fps, 3)
    pairs = [(int(a), int(b)) for a in fps for b in fps if int(a ^ b).bit_count() <= 3]
    assert roots_by_hand(links, fps.tolist()) == roots_by_hand(pairs, fps.tolist())
    assert len(links) < len(set(fps.tolist()))


def test_simhash_of_awkward_rows(spark):
    found = simhash.near_duplicates(data.documents(spark)).collect()
    assert len(found) == len(data.rows())
    by = {r.doc_id: r.component_id for r in found}
    assert by[34] == 0 and by[31] == by[32] == 30  # the copy; empty texts
    assert simhash.near_duplicates(data.empty(spark)).count() == 0


def groups_of(df):
    """{doc_id: least doc_id of its group} by the near-copy operator."""
    rows = copies.near_copies(df).collect()
    least = {}
    for r in rows:
        least[r["__copy_group"]] = min(least.get(r["__copy_group"], r.doc_id), r.doc_id)
    assert {r.doc_id for r in rows if r["__copy_kept"]} == set(least.values())
    return {r.doc_id: least[r["__copy_group"]] for r in rows}


def test_near_copies_by_words(spark):
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    changed = [w if k not in (40, 90) else "other" for k, w in enumerate(base)]
    others = [[f"w{rng.randint(0, 10**6)}" for _ in range(150)] for _ in range(5)]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate([base, changed, *others, base])], "doc_id long, text string")
    assert groups_of(df) == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 0}


def test_near_copies_are_told_apart_by_row(spark):
    rng = random.Random(9)
    a, b, c = (" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(60)) for _ in range(3))
    rows = [(1, a), (1, a), (2, a), (2, b), (None, b), (None, c), (3, None), (4, ""), (5, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__copy_row", F.lit("clash"))
    kept = sorted(((r.doc_id, r.text) for r in copies.keep_first(df).collect()), key=str)
    assert kept == sorted([(1, a), (2, b), (None, c), (3, None)], key=str)
    found = copies.keep_first(data.documents(spark))
    assert found.columns == data.documents(spark).columns
    # Two copies, and of three texts without a word two, go.
    assert found.count() == len(data.rows()) - 4
    assert copies.keep_first(data.empty(spark)).count() == 0


def test_large_bands_are_compared_in_blocks(spark, monkeypatch):
    """Groups that only a follower connects, in bands above the block size."""
    monkeypatch.setattr(copies, "BLOCK", 4)
    monkeypatch.setattr(copies, "bands_of", lambda x: [7] if len(x) else [])
    texts = copies_near_the_threshold(5)[:120]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, t.split()) for i, t in texts)}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert groups_of(df) == roots_by_hand(pairs, sets) and len(pairs) > 10


def copies_near_the_threshold(seed: int) -> list[tuple[int, str]]:
    """Texts of one to nine changed words, on both sides of 0.8, and word bags shuffled."""
    rng = random.Random(seed)
    out = []
    for _ in range(40):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([3, 30, 100, 300]))]
        out.append(" ".join(base))
        for _ in range(3):
            words = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 25))):
                words[rng.randrange(len(words))] = "other"
            out.append(" ".join(words))
        rng.shuffle(base)
        out.append(" ".join(base))
    rng.shuffle(out)
    return list(enumerate(out))


def test_near_copies_equal_all_pairs_of_shingle_sets(spark):
    texts = copies_near_the_threshold(12)
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, t.split()) for i, t in texts)}
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    pairs = [p for p, s in alike.items() if s >= 0.8]
    assert sum(0.8 <= s < 0.87 for s in alike.values()) > 10 and sum(0.7 < s < 0.8 for s in alike.values()) > 10
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert groups_of(df) == roots_by_hand(pairs, sets)


def test_long_runs_lose_no_link():
    """Two segments in one key differ in two bits at most: linked in a long run too."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flip = lambda x, n: x ^ np.uint64(sum(1 << int(k) for k in rng.choice(43, n, replace=False)))
    fps = np.unique(np.array([flip(x, n) for x in base for n in (0, 1, 2, 2)], np.uint64))
    links = simhash.long_run_links(fps, 0, 3)
    pairs = [(int(a), int(b)) for a in fps for b in fps if int((a ^ b) & np.uint64((1 << 43) - 1)).bit_count() <= 2 and int(a ^ b).bit_count() <= 3]
    got, want = roots_by_hand(links, fps.tolist()), roots_by_hand(pairs, fps.tolist())
    assert all(got[a] == got[b] for a in want for b in [want[a]])


def test_fingerprint_classes_without_ids(spark):
    df = spark.createDataFrame([(None, "one two three"), (None, "one two three"), (4, "one two three"), (None, "x")], "doc_id long, text string")
    found = simhash.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in found) == [("4", "4"), ("None", "4"), ("None", "4"), ("None", "None")]


def test_components_of_chains_and_stars(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(5, 5), (3, 4), (200, 201), (201, 202), (199, 202)]
    links = spark.createDataFrame(pairs, "u long, v long")
    found = {r.node: r.root for r in components.components(links).collect()}
    want = roots_by_hand(pairs, {n for p in pairs for n in p})
    assert found == {n: r for n, r in want.items() if n != r}
    assert components.components(links.where("u < 0")).count() == 0


# -- op8 ------------------------------------------------------------------------


def lines_table(spark):
    rng = random.Random(6)
    passage = data.sentence(rng, 60)
    docs = []
    for i in range(40):
        lines = [data.sentence(rng, 12) for _ in range(4)]
        if i < 12:
            lines.insert(2, "Licensed under the terms of version 3 of the agreement.")
        if i < 10:
            lines.insert(1, f"Posted by user {rng.choice(data.WORDS)} on the public board at {i} hours today.")
            # The same leaf, another template.
            lines.insert(0, f"Posted by user {rng.choice(data.WORDS)} of our friends from {rng.choice(data.WORDS)} the day before.")
        if 10 <= i < 16:
            lines.append(f"Sent by {rng.choice(data.WORDS)}{i} from here")
        if 20 <= i < 30:
            lines.append("Thanks.")
        if 30 <= i < 35:
            lines.append(passage)
        docs.append((i, "\n".join(lines)))
    # Copies of one text, copies with a changed line, and copies of one that quotes.
    copy = [data.sentence(rng, 12) for _ in range(5)]
    docs += [(100 + k, "\n".join(copy)) for k in range(20)]
    other = [data.sentence(rng, 12) for _ in range(8)]
    for k in range(20):
        changed = list(other)
        changed[k % 8] = data.sentence(rng, 12)
        docs.append((200 + k, "\n".join(changed)))
    docs += [(300 + k, docs[0][1]) for k in range(60)]
    # Heads and feet that stand first and last in every order, and a passage between.
    for k in range(60):
        lines = [data.sentence(rng, 10) for _ in range(3)]
        if k < 8:
            lines.append("A notice that stands between the two and that eight have.")
        docs.append((400 + k, "\n".join(["0000 the head of them all", *lines, "~~~~ the foot of them all"])))
    return docs, spark.createDataFrame(docs, "doc_id long, text string"), passage


def test_recurring_lines_go_and_the_rest_stays(spark):
    docs, df, passage = lines_table(spark)
    found = {r.doc_id: r for r in line_dedup.line_dedup(df).collect()}
    starts = ("Licensed under", "Posted by", "Sent by", "0000 the head", "~~~~ the foot", "A notice that", passage)
    for i, t in docs:
        want = [x for x in t.split("\n") if not x.startswith(starts)]
        assert found[i].text == "\n".join(want), i
        assert found[i].n_dropped == t.count("\n") + 1 - len(want)


def test_line_dedup_equals_its_sql(spark):
    import duckdb

    _, df, _ = lines_table(spark)
    documents = df.toPandas()  # noqa: F841
    want = duckdb.sql(line_dedup.ORACLE).df().set_index("doc_id").n_dropped.to_dict()
    assert {r.doc_id: r.n_dropped for r in line_dedup.line_dedup(df).collect()} == want


def test_line_dedup_of_awkward_rows(spark):
    docs = data.documents(spark)
    found = line_dedup.line_dedup(docs)
    assert set(found.columns) == {*docs.columns, "n_dropped"}
    by = {r.doc_id: r for r in found.collect()}
    assert len(by) == len({r[0] for r in data.rows()})
    assert by[30].text is None and by[31].text == "" and by[32].text == " \t\n \n" and by[32].n_lines == 3
    assert found.count() == len(data.rows()) and line_dedup.line_dedup(data.empty(spark)).count() == 0


def test_line_dedup_tells_rows_apart(spark):
    """Rows that share an id, or have none, lose their own lines only; long texts at once."""
    rng = random.Random(3)
    line = "This very line stands in all of them."
    rows = [(None, data.sentence(rng, 9) + "\n" + line), (1, data.sentence(rng, 9)), *((1, line + "\n" + data.paragraph(rng)) for _ in range(6)), (2, "\n".join([line] * 30_000 + ["The end of it."]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__line_row", F.lit("clash"))
    found = line_dedup.line_dedup(df).collect()
    assert sorted(r.text for r in found) == sorted(t.replace(line + "\n", "").replace("\n" + line, "") for _, t in rows)
    assert sum(r.n_dropped for r in found) == 30_007


def test_line_dedup_works_out_each_line_once(spark, monkeypatch):
    """A lambda is interpreted: what its body names twice is worked out twice. Weights gather
    no lists, which are sorted at more than a few keys."""
    plans = {}

    def written(df, label):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return common.written(df, label)

    monkeypatch.setattr(line_dedup, "written", written)
    monkeypatch.setattr(line_dedup, "ROUNDS", 1)
    line_dedup.line_dedup(data.documents(spark))
    assert plans["line-cut"].count("replace(lambda") == 1 and plans["line-cut"].count("md5(") == 1
    assert plans["line-cut"].count("concat(lambda") == 1
    assert "collect_list" not in plans["line-weights"] and "max(CASE WHEN" in plans["line-weights"]


def test_line_weights_by_hand(spark):
    rng = random.Random(8)
    rows = [[rng.randint(0, 3) if rng.random() < share else rng.getrandbits(58) for _ in range(line_dedup.ORDERS)] for share in (0.0, 0.2, 0.5, 1.0) for _ in range(30)]
    rows += [rows[0]] * 7 + [rows[40]] * 3 + [rows[119]] * 2
    # As min_hashes gives them: the order is part of the number.
    least = [[v * 16 + j for j, v in enumerate(r)] for r in rows]
    df = spark.createDataFrame([(hash(tuple(r)), r) for r in least], "sig long, least array<long>")
    held = Counter((j, v) for r in least for j, v in enumerate(r))
    want = {hash(tuple(r)): line_dedup.WHOLE // sorted((held[j, v] for j, v in enumerate(r)), reverse=True)[line_dedup.RANK - 1] for r in least}
    found = line_dedup.weights(df).collect()
    assert {r.sig: r.weight for r in found} == want and len(found) == len(want) and len(set(want.values())) > 3
