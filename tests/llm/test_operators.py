"""Every operator against plain Python on a small table of awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from moodmill.llm import (
    decontaminate,
    fingerprints,
    jaccard_join,
    language_id,
    packing,
    secret_scan,
    substring_dedup,
    suffix_dedup,
    token_counts,
    warc,
)
from moodmill.runtime import scratch_path

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
# columns whose names an operator might want for itself
SCHEMA = "doc_id long, text string, lang string, n long, sig long, h string, w string, bucket int"

WORDS = [f"w{chr(97 + i % 26)}{i}" for i in range(400)]


def awkward_texts() -> list[str | None]:
    rng = random.Random(7)

    def prose(n: int) -> list[str]:
        return [rng.choice(WORDS) for _ in range(n)]

    base, passage = prose(300), prose(60)
    near = [list(base) for _ in range(12)]
    for copy in near:
        for _ in range(3):
            copy[rng.randrange(len(copy))] = "changed"
    texts = [None, "", " ", "\n\n\t", "one", "one two three", "One TWO three", "a b c d e", "a b c d e f"]
    texts += [" ".join(base)] * 4 + [" ".join(n) for n in near]
    texts += [" ".join(prose(80) + passage + prose(90)) for _ in range(10)]
    texts += ["x" * 700, "ab" * 300, "spam " * 300, "ÄÖ ß é 日本   end", "tab\tline\r\nend  two  "]
    texts += [" ".join(prose(6000)), " ".join(base[:225]), " ".join(base[:224]), "…" * 50]
    texts += ["<|endoftext|> a  <|endoftext|>", "<s> ▁ </s>", "A-Z " + " ".join(passage).upper()]
    return texts


@pytest.fixture(scope="module")
def rows():
    return [(i, t, None, 1, 2, "h", None, 3) for i, t in enumerate(awkward_texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df) -> dict:
    found = df.collect()
    assert len({r["doc_id"] for r in found}) == len(found)
    return {r["doc_id"]: r for r in found}


def words_of(text, pattern=r"[^\x20\x09-\x0D]+", lower=False):
    text = text or ""
    if lower:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return re.findall(pattern, text)


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def test_token_counts(spark, docs, rows, none):
    model = token_counts.load_counter(PIECES).model
    cache = scratch_path(spark, "test-cache")
    found = by_id(token_counts.count_tokens(docs, PIECES, cache, limit=100))
    for i, text, *_ in rows:
        n = len(model.encode(text or ""))
        assert found[i][1:] == (len((text or "").encode()), n, n > 100)
    stored = token_counts.read_cache(
        spark, f"{cache}/version={token_counts.tokenizer_version(PIECES)}"
    )
    assert stored.count() == len({t or "" for _, t, *_ in rows})
    # a second run has no misses and appends nothing
    again = by_id(token_counts.count_tokens(docs, PIECES, cache, limit=100))
    assert again == found
    assert stored.sparkSession.read.parquet(cache).count() == len({t or "" for _, t, *_ in rows})
    assert token_counts.count_tokens(none, PIECES, scratch_path(spark, "c")).count() == 0
    with_json = by_id(token_counts.count_tokens(docs, BYTES, cache))
    whole = packing.TokenIds(BYTES).whole
    assert all(
        with_json[i]["n_tokens"] == len(whole.encode(t or "", add_special_tokens=False).ids)
        for i, t, *_ in rows
    )


def test_word_counts_equal_whole_texts():
    counter, ids = token_counts.load_counter(PIECES), packing.TokenIds(BYTES)
    parts = [" ", "  ", "\n", "\t", " ", "　", "é", "▁", "<s>", "ﬁ", "😀", "'s", "12",
             "\x1c", "​", "\r\n", "the", "\x00", "ſ", "<|endoftext|>", "İ"]
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert counter.count(text) == len(counter.model.encode(text)), text
        whole = ids.whole.encode(text, add_special_tokens=False).ids
        assert ids.of(text) == np.array(whole, "<u4").tobytes(), text


def test_packing(docs, rows, none):
    whole = packing.TokenIds(BYTES).whole
    pieces = defaultdict(list)
    found = packing.pack(docs, BYTES).collect()
    for r in found:
        pieces[r["doc_id"]].append(r)
    for i, text, *_ in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own, at = sorted(pieces[i], key=lambda r: r["start"]), 0
        for r in own:
            assert r["start"] == at and r["length"] & (r["length"] - 1) == 0 and r["offset"] == 0
            assert 1 <= r["length"] <= 1024 and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at].tobytes())
        assert at == len(ids)
    assert sorted(r["sequence_id"] for r in found) == list(range(len(found)))
    # the buckets of equal lengths follow each other
    lengths = [r["length"] for r in sorted(found, key=lambda r: r["sequence_id"])]
    assert lengths == sorted(lengths)
    assert packing.pack(none, BYTES).count() == 0


def shingles(text):
    words = words_of(text, lower=True)
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def smallest(links, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_jaccard_join(docs, rows, none):
    sets = {i: shingles(t) for i, t, *_ in rows}
    links = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
        and sets[b]
    ]
    want = smallest(links, sets)
    found = by_id(jaccard_join.link_components(docs))
    assert {i: tuple(r[1:]) for i, r in found.items()} == {
        i: (len(sets[i]), want[i]) for i in sets
    }
    assert jaccard_join.link_components(none).count() == 0
    one = jaccard_join.one_of_each(docs)
    assert one.columns == docs.columns
    assert {r["doc_id"] for r in one.collect()} == set(want.values())


def test_jaccard_join_of_null_and_repeated_ids(spark):
    rng = random.Random(12)

    def prose():
        return [rng.choice(WORDS) for _ in range(120)]

    def near(words):
        return " ".join([*words[:60], "changed", *words[61:]])

    a, b, c, d = prose(), prose(), prose(), prose()
    rows = [(None, " ".join(a)), (None, near(a)), (None, " ".join(b)), (4, near(b)), (9, " ".join(c))]
    rows += [(9, " ".join(d)), (5, near(c)), (8, near(d)), (8, near(d)), (9, " ".join(c)), (None, None)]
    rows += [(None, ""), (9, " ")]
    texts = dict(enumerate(t for _, t in rows))
    sets = {k: shingles(t) for k, t in texts.items()}
    links = [
        (x, y) for x in sets for y in sets if x < y and sets[x] and sets[y]
        and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y])
    ]
    groups = smallest(links, sets)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[groups[k]] = min(least.get(groups[k], 99), -1 if i is None else i)
    want = [
        (i, len(sets[k]), None if least[groups[k]] < 0 else least[groups[k]])
        for k, (i, _) in enumerate(rows)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = jaccard_join.link_components(docs).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    kept = [tuple(r) for r in jaccard_join.one_of_each(docs).collect()]
    assert Counter(smallest(links, sets)[rows.index(r)] for r in kept) == Counter(
        set(groups.values())
    )


def test_jaccard_bounds_hold_for_every_size():
    """The cells a set sends leave a partner at least as many as the search relies on."""
    rng = np.random.default_rng(3)
    for n in [1, 2, 3, 4, 5, 7, 8, 12, 20, 100, 200, 255, 256, 257, 300, 700, 2047, 2048, 2500]:
        for _ in range(6):
            m = int(rng.integers(max(1, -(-3 * n // 4)), n + 1))
            common = -(-75 * (n + m) // 175)
            if common > m:
                continue
            ids = rng.integers(0, 2**64, n + m - common, dtype=np.uint64)
            a, b = np.unique(ids[:n]), np.unique(ids[n - common :])
            sent = []
            for own in (a, b):
                sets = object.__new__(jaccard_join.Sets)
                sets.hashes, sets.rows = own, np.zeros(len(own), np.int64)
                sets.sizes = np.array([len(own)])
                sent.append(
                    {int(s) for sigs, _ in jaccard_join.signatures(sets, np.array([True])) for s in sigs}
                )
            assert sent[0] & sent[1], (n, m)


def test_frequent_signatures_reach_the_same_result(docs, rows, monkeypatch):
    from moodmill.llm import signatures

    monkeypatch.setattr(signatures, "FREQUENT", 2)
    monkeypatch.setattr(signatures, "BLOCK_SIGNATURES", 500)
    plain = by_id(jaccard_join.link_components(docs))
    monkeypatch.undo()
    assert plain == by_id(jaccard_join.link_components(docs))


def test_side_groups_hold_one_block(monkeypatch):
    from moodmill.llm import signatures

    sides = []
    for task in (0, 256, 512):
        context = type("Context", (), {"get": lambda t=task: type("T", (), {"partitionId": lambda: t})})
        monkeypatch.setattr(signatures, "TaskContext", context)
        sender = signatures.Sender(16)
        for _ in range(2):
            list(sender.add(np.full(20, 5, np.uint64), np.arange(20)))
            mail = sender.send()
            sides += mail["side"][mail["side"] >= 0].tolist()
    assert len(sides) == len(set(sides)) == 6


ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|"""
    r"""[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def base_spans(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


SECRETS = [
    None,
    "",
    "PassWord: hunter2hunter ok",
    "paſsword: nothunter2",  # a long s is no s
    "ünter token = 'abc' token='abcdef' x AKIA" + "Z" * 16 + " AKIAAKIA" + "Q" * 12,
    "sha " + "0123456789abcdef" * 2 + " and " + "deadbeef" * 2,
    'db_pwd = "q8Zt!x91LpW2"\nname = "just a name"\nretry: 30',
    'k1 = "Zx81kQ02mN"\nk2 = k1\nprivate_key = k2 + "Tt9!ab_77"',
    "{'apiKey': 'A1b2C3d4E5f6', 'note': \"secret: 12345\"}",
    "auth-token: 9f8a7B6c5D4e3F2a\npassword: ${PASSWORD}\npassphrase = changeme",
    "secret=" + "y" * 5000,
]


def test_secret_scan(spark, none):
    table = spark.createDataFrame([(i, t) for i, t in enumerate(SECRETS)], "doc_id long, text string")
    found = by_id(secret_scan.scan(table))
    kinds = ("assign", "access", "hex", "literal")
    spans = {}
    for i, text in enumerate(SECRETS):
        text = text or ""
        base = base_spans(text)
        count = Counter(k for _, k, _ in base)
        assert found[i][1:4] == (count[0], count[1], count[2]), text
        assert found[i]["base_sha256"] == sha(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in base))
        spans[i] = [s.split(":") for s in found[i]["spans"].split(",") if s]
        assert {(int(a), kinds.index(k), int(b)) for k, a, b in spans[i]} >= set(base)
    literals = {
        i: {SECRETS[i][int(a) : int(b)] for k, a, b in own if k == "literal"}
        for i, own in spans.items()
    }
    assert literals[6] == {"q8Zt!x91LpW2"}
    assert literals[7] == {"Zx81kQ02mN", "Tt9!ab_77"}  # passed on through k2
    assert "A1b2C3d4E5f6" in literals[8]
    assert literals[9] == {"9f8a7B6c5D4e3F2a"}
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(table).collect()}
    assert clean[0] is None and clean[1] == "" and clean[3] == SECRETS[3]
    assert clean[7] == 'k1 = "[secret]"\nk2 = k1\nprivate_key = k2 + "[secret]"'
    assert secret_scan.scan(none).count() == 0


SOURCE = [
    'config["password"] = "hunter2Xy9Qz"',
    "os.environ['API_TOKEN'] = 'hunter2Xy9Qz'",
    "$config['db']['secret'] = 'hunter2Xy9Qz';",
    'password = f"hunter2Xy9Qz"',
    'db_pwd = b"hunter2Xy9Qz"',
    "auth_key = rb'hunter2Xy9Qz'",
    'password: Optional[str] = "hunter2Xy9Qz"',
    'secret: Dict[str, List[str]] = "hunter2Xy9Qz"',
    'let pwd: Option<String> = "hunter2Xy9Qz";',
    'pwd: str | None = "hunter2Xy9Qz"',
    'password =\n    "hunter2Xy9Qz"',
    'password = \\\r\n    "hunter2Xy9Qz"',
    'passphrase = "a" +\n    "hunter2Xy9Qz"',
    'settings:\n  db_pwd: hunter2Xy9Qz',
    'settings:\n  "db_pwd": "hunter2Xy9Qz"',
]


def test_secrets_in_source_syntax(spark):
    table = spark.createDataFrame(list(enumerate(SOURCE)), "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(table).collect()}
    assert [t for i, t in enumerate(SOURCE) if "hunter2Xy9Qz" in clean[i]] == []
    assert clean[0] == 'config["password"] = "[secret]"' and clean[4] == 'db_pwd = b"[secret]"'
    # long runs of white space are read once
    assert secret_scan.scan_text("token:" + " " * 200_000 + "\n" * 200_000)[1] == []


def removed_words(rows):
    seen, want = {}, {}
    for i, text, *_ in rows:
        words = words_of(text)
        for k in range(len(words) - 12):
            seen.setdefault(tuple(words[k : k + 13]), i)
    for i, text, *_ in rows:
        words = words_of(text)
        gone = set()
        for k in range(len(words) - 12):
            if seen[tuple(words[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        kept = [w for k, w in enumerate(words) if k not in gone]
        want[i] = (len(words), len(gone), sha(" ".join(kept)))
    return want


def removed_bytes(rows):
    seen, want = set(), {}
    for i, text, *_ in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - 99):
            part = data[k : k + 100]
            if part in seen:
                gone[k : k + 100] = True
            seen.add(part)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[i] = (len(data), int(gone.sum()), runs, sha(kept))
    return want


@pytest.mark.parametrize("frequent", [5000, 3])
def test_substring_dedup(docs, rows, none, monkeypatch, frequent):
    from moodmill.llm import anchors

    monkeypatch.setattr(anchors, "FREQUENT", frequent)
    found = by_id(substring_dedup.dedup(docs))
    assert {i: tuple(r[1:]) for i, r in found.items()} == removed_words(rows)
    assert substring_dedup.dedup(none).count() == 0


@pytest.mark.parametrize("frequent", [5000, 3])
def test_suffix_dedup(docs, rows, none, monkeypatch, frequent):
    from moodmill.llm import anchors

    monkeypatch.setattr(anchors, "FREQUENT", frequent)
    found = by_id(suffix_dedup.dedup(docs))
    assert {i: tuple(r[1:]) for i, r in found.items()} == removed_bytes(rows)
    assert suffix_dedup.dedup(none).count() == 0


def shared_ids() -> list[tuple]:
    rng = random.Random(9)

    def prose(n: int) -> str:
        return " ".join(rng.choice(WORDS) for _ in range(n))

    passage, other = prose(40), prose(50)
    texts = [prose(80) + " " + passage, passage, prose(5) + " " + other, None, other + " " + prose(90)]
    texts += [passage + " " + other, prose(200) + " " + other, "short", passage]
    return list(zip([None, None, None, None, None, 5, 5, 5, 5], texts, strict=True)) + [
        (6, prose(30) + " " + other), (None, passage), (-3, passage + " " + prose(8)),
    ]


def kept_of_shared_ids(rows, size, split, joined):
    """Per row id, symbols, removed ones and digest; a window goes if a lesser id has it, and
    with bytes also if it starts earlier under the same id."""
    order = [(-(2**63) if i is None else i, split(t or "")) for i, t in rows]
    first = {}
    for i, symbols in order:
        for k in range(len(symbols) - size + 1):
            own = (i, k if size == 100 else 0)
            part = tuple(symbols[k : k + size])
            first[part] = min(first.get(part, own), own)
    out = []
    for (i, symbols), (doc_id, _) in zip(order, rows, strict=True):
        gone = set()
        for k in range(len(symbols) - size + 1):
            if first[tuple(symbols[k : k + size])] < (i, k if size == 100 else 0):
                gone |= set(range(k, k + size))
        kept = [x for k, x in enumerate(symbols) if k not in gone]
        out.append((doc_id, len(symbols), len(gone), sha(joined(kept))))
    return sorted(map(str, out))


def test_dedup_of_null_and_repeated_ids(spark):
    rows = shared_ids()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    found = substring_dedup.dedup(docs).select(columns).collect()
    want = kept_of_shared_ids(rows, 13, str.split, " ".join)
    assert sorted(str(tuple(r)) for r in found) == want
    columns[1] = "n_bytes"
    found = suffix_dedup.dedup(docs).select(columns).collect()
    want = kept_of_shared_ids(rows, 100, lambda t: list(t.encode()), bytes)
    assert sorted(str(tuple(r)) for r in found) == want


def test_suffix_array_of_small_alphabets():
    rng = random.Random(3)
    for _ in range(600):
        text = [rng.randint(1, rng.choice([1, 2, 5])) for _ in range(rng.randrange(40))]
        order = suffix_dedup.suffix_array(np.array(text, np.int64)).tolist()
        assert order == sorted(range(len(text)), key=lambda i: text[i:])


def test_automaton_finds_the_least_document():
    rng = random.Random(4)
    for _ in range(200):
        texts = [[rng.choice(b"abc") for _ in range(rng.randint(3, 12))] for _ in range(5)]
        texts = [[bytes([c]) for c in t] for t in texts]
        automaton = substring_dedup.Automaton()
        for doc, text in enumerate(texts):
            automaton.add(text, doc)
        automaton.close()
        for text in texts:
            want = [
                min(d for d, t in enumerate(texts)
                    if any(t[j : j + 3] == text[k : k + 3] for j in range(len(t))))
                for k in range(len(text) - 2)
            ]
            assert automaton.least_docs(text, 3) == want


def bench_words(text):
    return words_of(text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower=True)


def test_decontamination(spark, docs, rows, none):
    texts = {i: t for i, t, *_ in rows}
    passage = words_of(texts[22])
    items = [
        ("b", " ".join(passage[75:110])),
        ("a", " ".join(passage[80:100]).upper() + "!"),
        ("10", "one two"),
        ("9", "ONE, two"),
        ("empty", "-- !"),
        (None, None),
        ("absent", "no such words stand anywhere in this table of texts at all dear reader"),
        ("twice", "spam spam spam"),
    ]
    bench = spark.createDataFrame(items, "item_id string, text string")
    wanted = []
    for item, text in items:
        words = bench_words(text)
        wanted += [(item, words[k : k + 13]) for k in range(max(1, len(words) - 12)) if words]
    found = by_id(decontaminate.contamination(docs, bench))
    for i, text in texts.items():
        words, hit, ids = bench_words(text), set(), set()
        for item, window in wanted:
            for k in range(len(words) - len(window) + 1):
                if words[k : k + len(window)] == window:
                    hit |= set(range(k, k + len(window)))
                    ids.add(item)
        want = (len(words), len(hit), len(ids), sha(",".join(sorted(ids))))
        assert tuple(found[i][1:]) == (*want, len(hit) > 0 and 20 * len(hit) >= len(words)), i
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not r["contaminated"] for r in found.values())
    assert decontaminate.contamination(none, bench).count() == 0
    nothing = decontaminate.contamination(docs, bench.limit(0)).agg(F.sum("n_hit"), F.count("*"))
    assert nothing.first() == (0, len(rows))


def test_decontamination_of_null_and_repeated_ids(spark):
    passage, prose = " ".join(WORDS[:20]), " ".join(WORDS[100:160])
    rows = [(None, passage), (None, prose), (None, None), (7, passage), (7, prose), (8, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([("i", passage)], "item_id string, text string")
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(
        map(str, [(None, prose), (None, None), (7, prose)])
    )
    assert decontaminate.contamination(docs, bench).count() == 6


def test_proximity(spark):
    docs = spark.createDataFrame(
        [(1, "alpha beta gamma delta"), (2, "alpha x beta gamma y delta"), (3, "delta alpha")],
        "doc_id long, text string",
    )
    bench = spark.createDataFrame([("i", "alpha beta gamma delta")], "item_id string, text string")
    windows, _ = decontaminate.windows_of(bench)
    pivots = decontaminate.rarest_terms(docs, windows)
    index = decontaminate.build_index(docs, pivots)
    exact = decontaminate.phrase_candidates(index, pivots)
    assert {r["doc_id"] for r in exact.collect()} == {1}
    near = decontaminate.proximity_matches(index, pivots, 2)
    assert {r["doc_id"] for r in near.collect()} == {1, 2}


def test_decontamination_runs_no_python(spark, docs):
    bench = spark.createDataFrame([("i", "one two")], "item_id string, text string")
    plan = decontaminate.contamination(docs, bench)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_fingerprints(docs, rows, none):
    found = by_id(fingerprints.fingerprint(docs))
    texts = [t or "" for _, t, *_ in rows]
    prints = {}
    for k, text in enumerate(texts):
        following = texts[(k + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = found[k]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == sha(edited)
        hasher = fingerprints.PhraseHasher()
        assert r["edited_fingerprint"] == fingerprints.shown(
            fingerprints.Parsed(edited, hasher).hashes
        )
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (r["near_next"] == 1) >= (text == following)
    assert fingerprints.fingerprint(none).count() == 0
    # the next document of these is another text, so half of one's own is nearer
    apart = [found[i] for i in range(25, 34)]
    assert all(r["near_edited"] > r["near_next"] for r in apart)


def test_fingerprint_estimates_phrase_overlap():
    rng = random.Random(2)
    hasher = fingerprints.PhraseHasher()
    text = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    other = text[:2500] + "".join(rng.choice("stuvwxyz ") for _ in range(1500))
    sets = []
    for t in (text, other):
        known: set[str] = set()
        fingerprints.phrase_ends(t, known)
        sets.append(known)
    exact = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    near = fingerprints.likeness(*(fingerprints.Parsed(t, hasher).hashes for t in (text, other)))
    assert abs(near - exact) < 0.15


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id")
    held = found.where("held_out").agg(
        F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*")
    ).first()
    assert held[0] >= 0.98 and held[1] > 100
    assert found.where("rejected").count() == 0
    for r in found.limit(50).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1


@pytest.mark.parametrize("left_out", ["en", "fr"])
def test_language_id_rejects_a_language_left_out_of_learning(spark, left_out):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fewer = docs.withColumn("lang", F.when(F.col("lang") != left_out, F.col("lang")))
    found = language_id.identify(fewer).join(docs.select("doc_id", "lang", "text"), "doc_id")
    long = found.where(F.length("text") >= 200)
    share = {
        r["lang"] == left_out: r["share"]
        for r in long.groupBy("lang").agg(F.avg(F.col("rejected").cast("int")).alias("share"))
        .orderBy(F.col("lang") != left_out, "share").collect()
    }
    assert share[True] >= 0.95 and share[False] <= 0.02


def test_language_id_on_awkward_rows(docs, rows, none):
    found = by_id(language_id.identify(docs))  # nothing is labelled
    assert {r["lang_pred"] for r in found.values()} == {"und"} and len(found) == len(rows)
    assert language_id.identify(none).count() == 0
    labelled = docs.withColumn("lang", F.when(F.col("doc_id") > 8, F.lit("xx")))
    found = by_id(language_id.identify(labelled))
    for i, text, *_ in rows:
        letters = re.search(r"[^\W\d_]", text or "")
        assert found[i]["lang_pred"] == ("xx" if letters else "und"), text
        assert found[i]["rejected"] or letters


def test_kneser_ney_sums_to_one():
    import pandas as pd

    words = Counter({"abba": 5, "abc": 2, "cab": 1, "bb": 3})
    counts = pd.concat(language_id.gram_counts(iter([pd.DataFrame(
        {"lang": "x", "text": [" ".join(w for w, n in words.items() for _ in range(n))]})])))
    models = language_id.fit(counts)
    characters = "abc "

    def log_p(word):
        return models.word_scores(np.array([word], object))[0][0, 0]

    # over all words of up to 12 letters, end included, nearly all of the mass is spent
    total, front = 0.0, [""]
    unseen = np.exp(models.floor[0])
    assert 0 < unseen < 1 / len(characters)
    for size in range(1, 8):
        front = [w + c for w in front for c in "abc"]
        total += float(np.exp(models.word_scores(np.array(front, object))[0][:, 0]).sum())
    assert 0.85 < total < 1.0
    assert log_p("abba") > log_p("bcca")


def test_warc(spark):
    same, small = "<p>" + "s" * 2000, "tiny"
    pages = [
        (1, "http://a", same, "x"), (2, "http://b\r\nX: y", same, "x"), (3, None, None, None),
        (4, "", "", None), (5, "u", small, None), (6, "u", small, None), (7, "u", same, None),
        (8, "u", "é" * 700, None), (9, "u", "WARC/1.1\r\n\r\n" * 200, None), (None, "u", "n" * 1200, None),
        (10, "u", "big" * 2_000_000, None), (5, "u", small, None),
    ]
    table = spark.createDataFrame(pages, "page_id long, url string, html string, digest string")
    found = warc.round_trip(table.repartition(2)).collect()
    assert len(found) == len(pages)
    want = []
    for page, _, html, _ in pages:
        data = (html or "").encode()
        revisit = html == same and page != 7
        want.append(
            (page, len(data), hashlib.sha1(data).hexdigest(),
             "revisit" if revisit else "response", 7 if revisit else None)
        )
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    assert warc.round_trip(table.limit(0)).count() == 0


def test_warc_files(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame(
        [(i, "u", f"page {i} " * 300) for i in range(40)], "page_id long, url string, html string"
    )
    records = warc.plan_records(pages.repartition(2))
    archives = warc.write_archives(records, archive_bytes=20_000)
    # one stream cut into rows is the same archive
    whole = archives.orderBy("archive").collect()
    cut = [
        (r["archive"], k, r["data"][k * 100 : (k + 1) * 100])
        for r in whole
        for k in range(-(-len(r["data"]) // 100))
    ]
    members = warc.normalise(spark.createDataFrame(cut, warc.ARCHIVE).repartition(3), in_parts=True)
    assert members.count() == 40 and archives.count() > 2
    out = tmp_path / "out"
    out.mkdir()
    files = warc.write_files(members, str(out)).collect()
    assert sum(f["records"] for f in files) == 40
    for f in files:
        data = open(f["path"], "rb").read()
        for line in open(f["path"] + ".idx"):
            name, kind, offset, length = line.split("\t")
            record = gzip.decompress(data[int(offset) : int(offset) + int(length)])
            assert record.startswith(b"WARC/1.1") and name.encode() in record and kind == "response"
    (tmp_path / "again").mkdir()
    back = warc.normalise(warc.read_files(spark, str(out)).where("archive LIKE '%.gz'"))
    assert warc.read_records(back).count() == 40
    with pytest.raises(Exception, match="ends inside a record"):
        broken = [("x", 0, __import__("gzip").compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))]
        warc.normalise(spark.createDataFrame(broken, warc.ARCHIVE)).count()


def test_chains_of_assignments_are_linear():
    """Each name is the sum of two earlier ones: the literals reach the last, each once."""
    lines = ['first = "Zq8vT2mLw4Xy"', 'second = "Kp3nR7sBd9Hu"']
    names = ["first", "second"] + [f"name{i}" for i in range(20_000)]
    lines += [f"{names[i]} = {names[i - 1]} + {names[i - 2]}" for i in range(2, len(names))]
    quiet = "\n".join(lines)
    assert secret_scan.literal_spans(quiet) == []
    text = quiet + f"\napi_secret = {names[-1]}\n"
    spans = secret_scan.literal_spans(text)
    assert [text[a:b] for a, _, b in spans] == ["Zq8vT2mLw4Xy", "Kp3nR7sBd9Hu"]
    # a name set anew before its use takes its old literal out of reach
    again = 'first = "Zq8vT2mLw4Xy"\nfirst = "Kp3nR7sBd9Hu"\npassword = first\n'
    assert [again[a:b] for a, _, b in secret_scan.literal_spans(again)] == ["Kp3nR7sBd9Hu"]
