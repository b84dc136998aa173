import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.functions import sizes
from docweave.operators import scores
from docweave.llm import editor, encoding, furniture, leak, lookalike, mix, names, pii, scan, split, tokens

HANGUL = "관리 규정 운영 지침 시행 계획 점검 결과 보고 심사 기준 위원회 보증금 도서관 신청서 변경 공고 확정 수수료".split()


# P1
KO = [f"{a} {b} {c}" for a in HANGUL for b in HANGUL[::3] for c in HANGUL[::4]]
FR = ["Le référent qualité approuve la clôture définitive", "La société complète l'annexe à l'égard des adhérents", "Der Träger prüft die Maßnahmen für die Übergangsfrist"] * 20
OTHER = ["料金表の見出し", "Положение о порядке", "½ 이상 ¾ 미만", "α계수와 β값", "※ 해당 없음", "「조례」 제3조"] * 6


@pytest.fixture(scope="module")
def model():
    return encoding.train(KO + FR + OTHER)


@pytest.mark.parametrize("chain", [c for c in encoding.CHAINS if c not in encoding.LOSSY and not c.startswith("latin-1")])
def test_chains_invert(model, chain):
    judge = encoding.Judge(model)
    found = restored = total = 0
    for text in KO[::9]:
        seen = encoding.garble(text, chain)
        if seen is None:
            continue
        total += 1
        v = judge.value(seen)
        found += v.garbled
        restored += v.restored == text
        if encoding.LOST not in seen:
            assert v.restored in (text, None) or v.restored == text
    assert total and found >= 0.9 * total
    if encoding.LOST not in "".join(filter(None, (encoding.garble(t, chain) for t in KO[::9]))):
        assert restored >= 0.9 * total


def test_clean_text_stays(model):
    judge = encoding.Judge(model)
    assert not [v for v in KO + FR + OTHER if judge.value(v).garbled]
    assert not judge.value("").garbled and not judge.value("plain ascii").garbled


def test_words_in_a_script_of_their_own_stay(model):
    judge = encoding.Judge(model)
    assert not judge.value("資料: 年例 報告").garbled and not judge.value("Положение о порядке хранения").garbled
    assert judge.value("관리 규정".encode("cp949").decode("gbk")).garbled


def test_partly_garbled(spark, model):
    whole = "관리 규정 운영 지침"
    part = "관리 " + encoding.garble("규정", "cp949>latin-1") + " 운영 지침"
    df = spark.createDataFrame([(1, part, "x"), (2, whole, "x"), (3, None, "x"), (4, "", "x"), (5, part, "x"), (6, "관리 \ufffd\ufffd 지침", "x")], "id long, value string, garbled string")
    got = {r.id: r.restored for r in encoding.mended(df, "value", model).collect()}
    assert got == {1: whole, 5: whole, 6: None}
    assert encoding.mended(df.filter("id > 99"), "value").count() == 0


# P2
def test_editor_round_trip():
    rng = random.Random(1)
    for word in HANGUL + ["examination", "clearing", "unsigned"]:
        assert editor.compose(editor.letters(word)) == word
        seen, target = editor.add_noise(word, rng)
        assert editor.compose(target) == word and len(seen) == len(target)


def test_editor_held_out_accuracy():
    words = [a + b for a in HANGUL for b in ("은", "는", "을", "이", "과", "에")] + [a + b for a in "read work play check build count" .split() for b in ("", "ing", "ed", "s")]
    model = editor.train(words)
    rng, right, n = random.Random(99), 0, 0
    for w in words:
        noise = editor.add_noise(w, rng)
        if noise and noise[0] and (seen := editor.compose(noise[0])) != w and seen not in words:
            n += 1
            near = [(model.score(seen, c), c) for c in words if editor.keys(c, False) & editor.keys(seen, True)]
            right += max((x for x in near if x[0] is not None), default=(0, None))[1] == w
    assert n > 50 and right >= 0.85 * n


def test_keys_leave_no_operation_out():
    """Whatever single letter of a word, or whatever two letters of a long Latin one, were misread: there is a common key."""
    parts = editor.letters("도서관운영위원회")
    known = editor.keys("도서관운영위원회", misread=False)
    for i, c in enumerate(parts):
        group = next(g for g in (editor._LEAD, editor._VOWEL, editor._TAIL) if c in g)
        for seen in set(group) - {c}:
            assert known & editor.keys(editor.compose([*parts[:i], seen, *parts[i + 1 :]]), misread=True)
    for word in ("examination", "committee", "furniture"):
        known = editor.keys(word, misread=False)
        reads = [(i, i + len(true), seen) for true, seen in editor.PAIRS for i in range(len(word)) if word.startswith(true, i)]
        for i, j, x in reads:
            assert known & editor.keys(word[:i] + x + word[j:], misread=True)
            for k, m, y in reads:
                if j <= k and len(x) == j - i == 1:
                    assert known & editor.keys(word[:i] + x + word[j:k] + y + word[m:], misread=True)


def test_editor_scores_the_operations_that_make_a_word():
    words = ["examination", "committee", "management", "temperature", *HANGUL] * 2
    model = editor.train(words)
    assert model.score("cornmittee", "committee") > 0 and model.score("cornmittee", "management") is None
    assert model.score("committee", "committee") == 0.0


SENTENCES = ["the committee shall review the annual budget of the housing office", "every member must answer the written petition within thirty days", "the harbour library will publish the revised notice before the audit"]


def pages(spark, texts, scan_id=1):
    return spark.createDataFrame([(scan_id, i + 1, scan_id * 100 + i, t) for i, t in enumerate(texts)], "scan_id long, page_no int, row_id long, text string")


def page(i, body):
    return "\n".join(["Annual Report Draft", "", *body, "", f"   - {i} -"])


def test_pages(spark):
    clean = [SENTENCES[i % 3] for i in range(30)]
    texts = [page(11 + k, clean) for k in range(4)]
    texts[1] = page(12, [*clean, "the comm-", "ittee shall rcview the annual budget", "short- and long-term plans"])
    texts[2] = page(13, [*clean, "pending the peti-"])
    texts[3] = page(14, ["tion the member", "", "294", "", *clean])
    repair = scan.Repair(pages(spark, texts))
    noise = {}
    for r in repair.noise().collect():
        noise.setdefault(r.row_id, set()).add(r.noise_kind)
    both = {"running_head", "page_number"}
    assert noise == {100: both, 101: both | {"hyphen", "misread"}, 102: both | {"hyphen"}, 103: both}
    text = {r.row_id: r.text for r in repair.paragraphs().collect()}
    assert "committee shall review the annual budget short- and long-term plans" in text[101]
    assert "Annual Report" not in text[101] and "- 12 -" not in text[101]
    assert text[102].endswith("pending the petition") and "294" in text[103]


def test_the_perceptrons_decide(spark, monkeypatch):
    """With the weights of the editor, the joiner and the furniture shuffled, the finds fall apart."""
    rng = random.Random(4)
    vocabulary = [*HANGUL, *"committee review annual budget housing office member answer written petition harbour library publish revised notice audit examination".split()]
    texts, want = [], set()
    for k in range(24):
        lines = [" ".join(rng.choice(vocabulary) for _ in range(8)) + "." for _ in range(24)]
        for i in (8, 12):
            word = rng.choice(vocabulary)
            if (noise := editor.add_noise(word, rng)) and noise[0]:
                lines[i] = f"{editor.compose(noise[0])} {lines[i]}"
                want.add((100 + k, "misread"))
        word = rng.choice([w for w in vocabulary if len(w) >= 6])
        lines[10], lines[11] = f"{lines[10][:-1]} {word[:3]}-", f"{word[3:]} {lines[11]}"
        want |= {(100 + k, x) for x in ("hyphen", "running_head", "page_number")}
        texts.append(page(31 + k, lines))
    df = pages(spark, texts)
    found = lambda: {(r.row_id, r.noise_kind) for r in scan.Repair(df).noise().collect()}
    right = found()
    assert len(right & want) >= 0.9 * len(want) and len(right - want) <= 0.05 * len(want)
    train, train_linear = editor.train, editor.train_linear

    def outcome():
        repair = scan.Repair(df)
        joined = {(r.first, r.second) for r in repair.joins.filter("joins").collect()}
        lines = {(r.row_id, i) for r in repair.pages.collect() for i in r.drop}
        return lines, joined, {(r.word, r.correction) for r in repair.corrections.collect()}

    def shuffled(words):
        """The rows of weights change places among the features, and their values among the labels."""
        model, mix = train(words), random.Random(1)
        rows = [np.array(mix.sample(list(r), len(r)), np.float32) for r in model.rows.values()]
        mix.shuffle(rows)
        return editor.Editor(model.allowed, dict(zip(model.rows, rows, strict=True)), model.labels)

    good = outcome()
    monkeypatch.setattr(editor, "train", shuffled)
    monkeypatch.setattr(editor, "train_linear", lambda *a, **k: editor.Linear({f: -w for f, w in train_linear(*a, **k).weights.items()}))
    bad = outcome()
    assert all(len(g) > 5 and len(g & b) <= 0.7 * len(g) for g, b in zip(good, bad, strict=True)), [(len(g), len(g & b)) for g, b in zip(good, bad, strict=True)]


def test_repaired_pages_read_as_the_clean_ones(spark):
    """Words misread, broken at line ends, and furniture, over pages whose clean text is known: word by word."""
    rng = random.Random(21)
    vocabulary = [*HANGUL, *"committee review annual budget housing office member answer written petition harbour library publish revised notice audit examination".split()]
    texts, clean = [], []
    for k in range(24):
        sentences = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(6, 10))) + "." for _ in range(20)]
        clean.append(" ".join(sentences))
        words, lines = clean[-1].split(), [""]
        for w in words:
            seen = w
            if rng.random() < 0.03 and w[-1] != "." and (noise := editor.add_noise(w, rng)) and noise[0]:
                seen = editor.compose(noise[0])
            if len(lines[-1]) + len(seen) > 50:
                if len(seen) > 6 and seen.isascii() and rng.random() < 0.3:
                    lines[-1] += " " + seen[:4] + "-"
                    lines.append(seen[4:])
                    continue
                lines.append(seen)
            else:
                lines[-1] = f"{lines[-1]} {seen}".strip()
        texts.append(page(61 + k, lines))
    got = {r.row_id: r.text for r in scan.Repair(pages(spark, texts)).paragraphs().collect()}
    right = total = 0
    for k, want in enumerate(clean):
        total += len(want.split())
        right += scores._lcs(got[100 + k].split(), want.split())
        assert "Annual Report Draft" not in got[100 + k] and f"- {61 + k} -" not in got[100 + k]
    assert right >= 0.985 * total, right / total


def test_heads_of_a_chapter_in_a_long_scan(spark):
    """A head on three pages of forty, longer than 90 characters."""
    head = "Provisions on the management of harbour libraries and on the housing of annual budgets in written petitions"
    rng = random.Random(8)
    body = lambda: [" ".join(rng.choice(SENTENCES).split()[: rng.randint(6, 11)]) + ("," if rng.random() < 0.5 else " and") for _ in range(20)]
    texts = [page(k, body()).replace("Annual Report Draft", head if 10 <= k < 13 else "Annual Report Draft") for k in range(1, 41)]
    got = {r.row_id for r in scan.Repair(pages(spark, texts)).noise().filter("noise_kind = 'running_head'").collect()}
    assert len(got) == 40


def test_pages_odd_inputs(spark):
    df = pages(spark, [None, "", "a", "b"])
    assert scan.Repair(df).noise().count() == 0
    assert scan.Repair(df.limit(0)).paragraphs().count() == 0
    assert furniture.number_of("xliv") == 44 and furniture.number_of("l6") == 16 and furniture.number_of("abc") is None


# P3
@pytest.fixture(scope="module")
def counter():
    return tokens.Counter(tokens.TOKENIZER)


@pytest.mark.parametrize("text", ["", " ", "a  b\n\n c", "it's  we'll 12 34", "가나 다라\t\t마", "x\x1c y\u3000 z", "\n\n\n", "🙂 🙂\r\n\r\n a"])
def test_segments_are_exact(counter, text):
    assert counter.count(text) == len(counter.encode(text))


def test_cuts_are_exact(spark, counter):
    rng = random.Random(5)
    alphabet = "ab 가나\n\t.,'s12 \u3000é"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(60)] + ["가" * 200, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").withColumn("tokens", F.lit("clash"))
    got = {r.id: r.tokens for r in tokens.token_counts(df, "id", "t", limit=20).collect()}
    assert got == {i: None if t is None else len(counter.encode(t)) for i, t in enumerate(texts)}
    rough = {r.id: r.tokens for r in tokens.token_counts(df, "id", "t", "estimate", limit=20).collect()}
    assert rough == {r.id: r.n for r in df.select("id", sizes.estimated_tokens(F.col("t")).alias("n")).collect()}
    chunks = spark.createDataFrame([("ab cd ef " * 20,)], "t string").select(tokens.independent_chunks(F.col("t"), 10).alias("c")).first().c
    assert "".join(chunks) == "ab cd ef " * 20 and all(len(c) <= 10 for c in chunks)


def test_budget(spark):
    df = spark.createDataFrame([("a", "x", 3), ("a", None, 4), ("b", "x", None)], "s string, l string, tokens long")
    got = {(r.s, r.l, r.level): (r.documents, r.tokens) for r in tokens.token_budget(df, ["s", "l"]).collect()}
    assert got[None, None, 3] == (3, 7) and got["a", None, 1] == (2, 7) and got["a", None, 0] == (1, 4) and got["b", "x", 0] == (1, 0)
    langs = spark.createDataFrame([(x,) for x in ("ko-KR", "KO", "kor", " ", None, "eng")], "l string").select(tokens.canonical_language(F.col("l")).alias("l"))
    assert [r.l for r in langs.collect()] == ["ko", "ko", "ko", None, None, "en"]


# P4
def estimate(text):
    return (8 * len(re.findall("[가-힣]", text)) + 3 * len(re.findall(r"[A-Za-z0-9\s]", text))) // 12


def test_pieces(spark):
    rng = random.Random(3)
    prose = " ".join(rng.choice(HANGUL) + rng.choice(["", ".", ",\n", ".\n\n"]) for _ in range(900))
    ideographs = "".join("漢" * rng.randint(5, 60) + rng.choice(["", " ", "word ", "。 "]) for _ in range(6000))
    texts = [prose, "가" * 3000, "word " * 3000, "x" * 9000, "|" * 20000 + "가" * 900, "\x02가 나\x01. " * 500, "", None, "짧은 글", ideographs, "|" * 40000 + "가나 다(라). " * 9000 + "|" * 70000 + "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    rows = {}
    for r in split.pieces_of(df, "id", "t").collect():
        rows.setdefault(r.row_id, []).append(r)
    assert set(rows) == {i for i, t in enumerate(texts) if t and estimate(t) > 512}
    for i, pieces in rows.items():
        pieces.sort(key=lambda r: r.piece_no)
        assert pieces[0].start == 0 and pieces[-1].stop == len(texts[i])
        for a, b in zip(pieces, pieces[1:]):
            shared = texts[i][b.start : a.stop]
            assert b.start <= a.stop < b.stop and b.piece_no == a.piece_no + 1 and estimate(shared) == min(50, estimate(texts[i][: a.stop]))
        assert all(p.n_tokens <= 512 and p.piece == texts[i][p.start : p.stop] for p in pieces)
    ends = [p.piece[-1] for p in rows[0][:-1]]
    assert all(e.isspace() for e in ends)
    # Few pieces: signs without weight don't count, nor does an overlap that the first piece doesn't have.
    assert len(rows[9]) <= estimate(ideographs) / 400 + 1 and len(rows[1]) == 5


# P5
@pytest.mark.parametrize(
    ("seen", "plain"),
    [("ＡＢＣ\u3000１", "ABC 1"), ("e" + chr(0x301), chr(0xE9)), (chr(0x1112) + chr(0x1161) + chr(0x11AB), "한"), ("a\u200bb\u00a0c", "ab c"), ("ﬁn", "fin"), (chr(0xF9BE), "料"), ("privаte", "private"), ("СОРУ", "СОРУ"), ("α값 μm", "α값 μm"), ("hօme", "home"), ("𝐇ello", "Hello"), ("ℌello", "Hello"), ("ᏚatᎢ", "SatT"), ("Հայաստան", "Հայաստան")]
    + [(s, s) for s in "① ㎡ Ⅲ ½ 「가」 “x” – ㆍ ㈜ ℃".split()],
)
def test_skeleton(seen, plain):
    assert lookalike.skeleton(seen) == plain


def test_unified(spark):
    rows = [("text_runs", 1, "관리 규정"), ("text_runs", 2, "관리\u3000규정"), ("text_runs", 3, "관리\u200b 규정"), ("text_runs", 4, None), ("text_runs", 5, ""), ("legal_chunks", 1, "관리 규정"), ("legal_chunks", 2, "cafe" + chr(0x301)), ("legal_chunks", 3, "CAFE")]
    df = spark.createDataFrame(rows, "table_name string, row_id long, value string")
    got = {(r.table_name, r.row_id): (r.canonical, r.altered) for r in lookalike.unified(df).collect()}
    assert got["text_runs", 2] == got["text_runs", 3] == ("관리 규정", True) and got["text_runs", 1] == ("관리 규정", False)
    assert got["legal_chunks", 2] == ("café", True) and got["legal_chunks", 3] == ("CAFE", False) and got["text_runs", 4] == (None, False) and got["text_runs", 5] == ("", False)


def test_plain_texts_differ_under_the_collation(spark):
    chars = [chr(c) for c in range(0x20, 0x2600) if re.fullmatch(f"[{lookalike.PLAIN}]", chr(c))] + ["가", "각", "힣", "「", "」"]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    assert df.groupBy(F.collate("c", "UNICODE")).count().filter("count > 1").count() == 0


def test_lookalikes_learn_from_all_values(spark):
    whole = "강당 관리 규정 운영 지침"
    garbled = encoding.garble(whole, "cp949>latin-1")
    # The clean words stand in values of more than 400 characters only.
    long = [" ".join(KO[i::9]) + " 강당 관리 " * 3 for i in range(9)]
    rows = [("text_runs", i, v) for i, v in enumerate(long)] + [("text_runs", 90, garbled), ("text_runs", 91, "관리\u3000규정"), ("text_runs", 92, None), ("legal_chunks", 90, "관리\u200b 규정")]
    df = spark.createDataFrame(rows, "table_name string, row_id long, value string")
    assert min(map(len, long)) > 400 and lookalike.skeleton(garbled) != garbled
    assert {(r.table_name, r.row_id) for r in lookalike.lookalikes(df).collect()} == {("text_runs", 91), ("legal_chunks", 90)}


def test_training_on_all_values(spark, monkeypatch):
    monkeypatch.setattr(encoding, "SAMPLE_VALUES", 5)
    odd = [encoding.garble(t, c) for t, c in zip(KO[::5], list(encoding.CHAINS) * 20)]
    values = KO + FR + OTHER + [v for v in odd if v] + [" ".join(KO[:80]), "", "a \x02\x03é\x02 b", "  é  𝐇ello "]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "value string")
    want, got = encoding.train(values), encoding.train_on_all(df.repartition(3), "value")
    assert np.allclose(got.table, want.table, atol=1e-3) and got.letters == want.letters and got.chains == want.chains
    again = encoding.train_on_all(df.repartition(7), "value")
    assert np.array_equal(got.table, again.table) and got.letters == again.letters
    assert encoding.train_on_all(df.filter("value is null"), "value").letters == frozenset()


# P7
def test_leaks(spark):
    words = [f"{a}{b}" for a in HANGUL for b in ("은", "을", "과")]
    rng = random.Random(7)
    item = lambda: " ".join(rng.choice(words) for _ in range(30))
    opening = "다음 글을 읽고 물음에 알맞은 답을 하나만 고르시오 그리고 그 까닭도 쓰시오"
    items = [(i, f"{opening} {item()}" if i < 4 else item()) for i in range(8)] + [(90, "짧은 글"), (91, None)]
    text = dict(items)
    noise = " ".join(rng.choice(words) for _ in range(60))
    half = " ".join(text[5].split()[:13])
    docs = [
        (1, f"{noise} {text[4]} {noise}"),
        (2, f"{noise} **{half}** {noise}"),
        (3, noise + " " + text[1].replace(" ", ",  ").upper()),
        (4, f"{opening} {noise}"),
        (5, noise.replace(" ", "") + text[6].replace(" ", "")),
        (6, None),
        (7, ""),
        (8, " ".join(text[7].split()[:9]) + " " + noise),
        (9, f"{noise} {text[4]} {noise}"),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(0))
    q = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leak.leaked(leak.leaks(d, q)).collect()}
    assert got == {(1, 4), (2, 5), (3, 1), (5, 6), (9, 4)}
    assert leak.leaks(d.limit(0), q).count() == 0


def test_many_short_passages_add_up(spark):
    """Half of a long item, in stretches of eight words far apart: no region reaches the least score."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    item = [word() for _ in range(400)]
    filler = lambda: " ".join(rng.choice("0123456789") * 6 for _ in range(800))
    passages = [" ".join(item[i : i + 8]) for i in range(0, 400, 16)]
    docs = spark.createDataFrame([(1, " ".join(f"{p} {filler()}" for p in passages)), (2, passages[0] + filler())], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    found = leak.leaks(docs, items).collect()
    assert [(r.doc_id, r.item_id, r.share) for r in found] == [(1, 7, 0.5)] and found[0].score < 0.05
    assert leak.leaked(leak.leaks(docs, items)).count() == 1


def test_edited_copies_are_told_by_alignment(spark):
    """Every seventh word replaced: no stretch of eight words is left, only the alignment score speaks."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
    item, other = [word() for _ in range(60)], [word() for _ in range(60)]
    edited = [word() if i % 7 == 6 else w for i, w in enumerate(item)]
    part = [*(word() for _ in range(40)), *item[:6], *(word() for _ in range(40)), *item[30:36]]
    docs = spark.createDataFrame([(i, " ".join([*(word() for _ in range(30)), *t])) for i, t in enumerate((edited, part, other))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    pairs = [(r.doc_id, r.share) for r in leak.leaks(docs, items).collect()]
    assert pairs == [(0, 0.0)] and leak.leaked(leak.leaks(docs, items)).count() == 0


def test_one_item_in_most_documents(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    texts = {i: " ".join(word() for _ in range(40)) for i in range(3)}
    docs = [(n, f"{word()} {texts[n % 3 if n % 10 == 0 else 0]} {word()}") for n in range(400)]
    got = leak.leaked(leak.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(texts.items()), "item_id long, text string")))
    assert sorted(map(tuple, got.collect())) == [(n, n % 3 if n % 10 == 0 else 0) for n in range(400)]


def test_alignment():
    def plain(a, b, low, high):
        h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
        for i in range(1, len(a) + 1):
            for j in range(max(1, i + low), min(len(b), i + high) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -2), h[i - 1][j] - 2, h[i][j - 1] - 2)
                best = max(best, h[i][j])
        return best

    rng = random.Random(2)
    text = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(0, 20)))
    pairs = [(text(), text(), -20, 20) for _ in range(150)] + [(text(), text(), low := rng.randint(-9, 12), low + rng.randint(0, 9)) for _ in range(150)]
    assert leak.smith_waterman(pairs) == [plain(*p) for p in pairs]


# P8
def test_mix(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(HANGUL) for _ in range(rng.randint(5, 40))), "hot" if i % 2 else rng.choice(["a", " A ", "b-c", "b_c"])) for i in range(600)]
    docs += [(900, None, "a"), (901, "", "a"), (902, "글", None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("tokens", F.lit("clash"))
    targets = spark.createDataFrame([(1, "hot", 0.2, 1), (1, "a", 0.5, 4), (1, "b_c", 0.2, 3), (1, "none", 0.1, 2), (2, "hot", 1.0, 2)], "plan_id int, source string, target_share double, max_repeats int")
    selection, shares = mix.mix(d, targets)
    rows = selection.collect()
    got = {(r.plan_id, r.source): r for r in shares.collect()}
    assert got[1, "none"].selected == 0 and got[2, "hot"].actual_share == 1.0 and got[2, "hot"].repeats == 2.0
    for (plan, source), r in got.items():
        mine = [x for x in rows if (x.plan_id, x.source) == (plan, source)]
        assert sum(x.tokens for x in mine) == r.selected and r.repeats <= r.max_repeats
        full = int(r.repeats)
        counts = {}
        for x in mine:
            counts[x.doc_id] = counts.get(x.doc_id, 0) + 1
        assert set(counts.values()) <= {full, full + 1} and len({(x.doc_id, x.epoch) for x in mine}) == len(mine)
    known = sum(r.target_share for (p, s), r in got.items() if p == 1 and s != "none")
    for s in ("hot", "a", "b_c"):
        assert abs(got[1, s].actual_share - got[1, s].target_share / known) < 0.01
    again = sorted(map(tuple, mix.mix(d.repartition(7), targets)[0].collect()))
    assert again == sorted(map(tuple, rows))


def test_sampling_follows_weights(spark):
    df = spark.range(20000).select(F.col("id"), (-F.log(mix.uniform(F.col("id"), 1)) / F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.5)).alias("k"))
    even = df.orderBy("k").limit(2000).filter("id % 2 = 0").count()
    assert 1250 < even < 1420  # two to one


# P9
@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("담당: 배가람 과장 (전화 010-1579-4694)", [("name", "배가람"), ("phone", "010-1579-4694")]),
        ("신청인 황슬린 (주민등록번호 900101-1234567)은 미르광역시 마루시 들머리리 7-6번지에 거주한다.", [("name", "황슬린"), ("id_number", "900101-1234567"), ("address", "미르광역시 마루시 들머리리 7-6번지")]),
        ("긴급 연락은 (02) 0295-0657 또는 공일공 일공구사 구삼팔사", [("phone", "02) 0295-0657"), ("phone", "공일공 일공구사 구삼팔사")]),
        ("문의는 <mailto:a.b+doc@mail.example> 또는 c-d 골뱅이 mail 점 example", [("email", "a.b+doc@mail.example"), ("email", "c-d 골뱅이 mail 점 example")]),
        ("회의에는 정 미 결, 손솔샘, 서차산 등이 참석하였다.", [("name", "정 미 결"), ("name", "손솔샘"), ("name", "서차산")]),
        ("The applicant, Ms Zola Fenwick (ID no. R52172639), resides at Flat 1, 160 Quillen Street, Orrisby.", [("name", "Zola Fenwick"), ("id_number", "R52172639"), ("address", "Flat 1, 160 Quillen Street, Orrisby")]),
        ("Contact : Mme Stroudel, Emrys, tél. 01 99 00 43 62", [("name", "Stroudel, Emrys"), ("phone", "01 99 00 43 62")]),
        ("전화 ０１０－１５７６－３７５４", [("phone", "０１０－１５７６－３７５４")]),
        ("사업자등록번호 839-29-61873, 문서번호 2023-0265-02727, tool@1.0.7, ●●●●●●-●●●●●●●, 3,750,000원", []),
        ("", []),
    ],
)
def test_entities(text, want):
    assert [(e.kind, e.text) for e in pii.find(text)] == want


def test_redaction(spark):
    text = "담당: 배가람 과장 (전화 010-1579-4694). 문의는 배가람 과장에게 x@y.example, Frau Anna Berg, 공일공 일공구사 구삼팔사."
    found, placed, natural = pii.redact(text, b"k")
    assert placed == "담당: [NAME_1] 과장 (전화 [PHONE_1]). 문의는 [NAME_1] 과장에게 [EMAIL_1], Frau [NAME_2], [PHONE_2]."
    m = re.fullmatch(r"담당: (...) 과장 \(전화 010-\d{4}-\d{4}\)\. 문의는 (...) 과장에게 [a-z]@[a-z]\.example, Frau ([A-Z][a-z]+(?:a|ia|ine|elle|ette) [A-Z][a-z]+), 공일공 [공일이삼사오육칠팔구]{4} [공일이삼사오육칠팔구]{4}\.", natural)
    assert m and m[1] == m[2] != "배가람" and "Anna" not in m[3] and "Berg" not in m[3]
    assert pii.redact(text, b"k") == (found, placed, natural) and pii.redact(text, b"other")[2] != natural
    df = spark.createDataFrame([(1, text, 5), (2, None, 5), (3, "", 5), (4, "글", 5)], "doc_id long, text string, entities int")
    got = {r.doc_id: r for r in pii.redacted(df, b"k").collect()}
    assert got[1].placeholders == placed and got[2].placeholders is None and got[3].placeholders == "" and got[4].entities == []
    assert {(r.pii_kind, r.start_pos) for r in pii.occurrences(pii.redacted(df, b"k")).collect()} == {(e.kind, e.start + 1) for e in found}


def test_mentions_of_one_person_agree():
    text = "Signed by Ada Miller. Contact: Miller, Ada. Checked by A. Miller. Ms Miller left. Drafted by Paul Miller. Mr Stone came."
    found, placed, natural = pii.redact(text, b"k")
    assert placed == "Signed by [NAME_1]. Contact: [NAME_1]. Checked by [NAME_1]. Ms [NAME_1] left. Drafted by [NAME_2]. Mr Stone came."
    m = re.fullmatch(r"Signed by (\w+) (\w+)\. Contact: (\w+), (\w+)\. Checked by (\w)\. (\w+)\. Ms (\w+) left\. Drafted by (\w+) (\w+)\. Mr Stone came\.", natural)
    given, family = m[1], m[2]
    assert (m[3], m[4], m[5], m[6], m[7], m[9]) == (family, given, given[0], family, family, family) and m[8] != given and len(found) == 4


def test_surrogate_addresses():
    texts = {"12 Baker Street, London": "Street", "미르광역시 마루시 들머리리 7-6번지": "번지", "Lindenstraße 14, 10115 Berlin": "straße", "7 rue de la Paix, 75002 Paris": "rue de la"}
    for text, kept in texts.items():
        made = pii.Surrogates(b"k").of(pii.Entity("address", 0, len(text), text))
        words = set(re.findall(r"[A-Z][a-z]{3,}|[가-힣]{4,}", text)) - {"Street"}
        assert kept in made and not any(w in made for w in words) and re.sub(r"\d", "0", re.sub(r"[^\d\W]+", "x", made)) == re.sub(r"\d", "0", re.sub(r"[^\d\W]+", "x", text))


def test_permutation_keeps_values_apart():
    s = pii.Surrogates(b"k")
    made = {s.encoded("phone", f"02-{i:04d}", set(range(3))) for i in range(10_000)}
    assert len(made) == 10_000 and all(re.fullmatch(r"02-\d{4}", x) for x in made)
    births = {s.of(pii.Entity("id_number", 0, 14, f"900101-1{i:06d}")) for i in range(500)}
    assert len(births) == 500 and all(x[7] == "1" and x[2] == "0" and x[4] == "0" for x in births)


@pytest.mark.parametrize("n", [50, 500])
def test_lists_are_read_to_their_end(n):
    latin = [f"Ada{'abcdefghij'[i % 10]} Mill{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i // 100]}" for i in range(n)]
    assert [e.text for e in pii.find("Present were " + ", ".join(latin[:-1]) + " and " + latin[-1] + ".")] == latin
    korean = ["배" + chr(0xAC00 + 20 * i) + "람" for i in range(n)]
    assert [e.text for e in pii.find("회의에는 " + ", ".join(korean) + " 등이 참석하였다.")] == korean


def test_long_entities_are_found_whole():
    long = "a" * 300
    assert [e.text for e in pii.find(f"write to {long}@{long}.example or {long} at {long} dot example.")] == [f"{long}@{long}.example", f"{long} at {long} dot example"]
    proper = "B" + long
    assert [e.text for e in pii.find(f"lives at 12 {proper} {proper} Street, {proper}.")] == [f"12 {proper} {proper} Street, {proper}"]
    assert [e.text for e in pii.find(f"Ms {proper} {proper} came")] == [f"{proper} {proper}"]


def test_tagger_on_phrasings_it_has_not_seen():
    """Frames and occupations that aren't in names.py, with names invented anew; and texts without names."""
    tagger, rng = names.train(), random.Random(99)
    frames = [("en", t) for t in ("Our colleague {n} lives here.", "The engineer {n} repaired the roof.", "We met {n} at the station.", "Nobody knew where {n} had gone.", "The letter was for {n}, who never read it.")]
    frames += [("de", t) for t in ("Die Ärztin {n} operierte gestern.", "Niemand wusste, wo {n} war.")] + [("fr", t) for t in ("La infirmière {n} ferma la porte.", "Personne ne savait où était {n}.")]
    frames += [("ko", t) for t in ("{n} 씨가 문을 닫았다.", "간호사 {n}은 퇴근했다.", "기술자 {n}이 수리했다.", "통역사 {n}가 옮겼다.")]
    right = 0
    for lang, frame in frames * 40:
        name = names.invented(rng, lang)
        text = frame.replace("{n}", name)
        right += [(e.kind, e.text) for e in pii.find(text, tagger)] == [("name", name)]
    assert right >= 0.8 * 40 * len(frames)
    none = ("The Harbour Office was closed in North Barrow.", "Section Two of the Building Code applies.", "Die Neue Ordnung gilt ab Montag Morgen.", "이 문제는 조사가 필요하다. 신청서는 전액 환급한다.", "La Cour et le Conseil siègent.", "Annual Report of the Water Board", "Die Allgemeine Prüfung endet.", "안전성과 유용성은 높다.")
    assert sum(len(pii.find(text, tagger)) for text in none) <= 1


def test_cues_without_digits(spark):
    """Every cue alone in a document, without digits, @ or any other cue."""
    ko, x = "배가람", "Anna Berg"
    texts = {f"{c}{ko} 과장": ko for c in ("담당: ", "담당자: ", "문의는 ", "신청인 ", "청구인 ", "피신청인: ", "대표자: ", "작성자: ", "검토자: ", "성명: ", "이 문서는 ", "작성하고 ", "수신인: ")}
    texts |= {f"회의에는 {ko} 등이 참석": ko, f"{ko}이 제출한 의견": ko, f"{ko}님께서 ": ko, f"{ko}님에게 ": ko, f"{ko} (인)": ko, f"{ko} (서명)": ko, f"{ko} 위원은 위 안건": ko}
    titles = "Mr Mrs Ms Miss Dr Prof Mme Mlle M. Herr Herrn Frau Monsieur Madame".split()
    verbs = "drafted Checked prepared Written approved signed Reviewed Attended".split()
    fields = "Name Nom Applicant Director Representative Manager Ansprechpartner Ansprechpartnerin Bearbeiter Verfasserin Rédacteur Rédactrice Auteur".split()
    before = [f"{t} " for t in titles] + [f"{v} by " for v in verbs] + [f"{f}: " for f in fields]
    before += ["and mention ", "Contact : ", "author=", "(signed) ", "Signed ", "signé ", "Signée ", "gezeichnet ", "gez. ", "Present were ", "Anwesend waren ", "Étaient présents "]
    texts |= {f"{c}{x}": x for c in before} | {f"{x} {v}": x for v in ("asked for", "objected to", "attended", "was present", "requested a copy")}
    texts |= {m: m for m in ("a-b at example dot com", "a-b (at) example (dot) com", "a-b 골뱅이 example 점 com", "영일공 일공구사 구삼팔사", "공일육 일공구사 구삼팔사")}
    rows = list(enumerate(texts))
    got = {r.doc_id: r.entities for r in pii.redacted(spark.createDataFrame(rows, "doc_id long, text string"), b"k").collect()}
    spans = {t: [t[e.start_pos - 1 : e.start_pos - 1 + e.length] for e in got[i]] for i, t in rows}
    assert spans == {t: [want] for t, want in texts.items()}


def test_empty_tables_and_nulls(spark):
    """Every operator of documents on empty tables, null and empty texts, and null page numbers."""
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, None), (3, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "x"), (2, None)], "item_id long, text string")
    assert leak.leaks(docs, items).count() == leak.leaks(docs, items.limit(0)).count() == leak.leaks(docs.limit(0), items).count() == 0
    assert pii.redacted(docs.limit(0), b"k").count() == 0 and pii.redacted(docs, b"k").count() == 3
    assert split.pieces_of(docs.limit(0), "doc_id", "text").count() == split.oversized(docs, "doc_id", "text").count() == 0
    scans = spark.createDataFrame([(1, None, 1, "head\nx y z\n- 3 -"), (None, 2, 2, "head\nx y\n"), (1, 3, 3, None)], "scan_id long, page_no int, row_id long, text string")
    repair = scan.Repair(scans)
    assert {(r.row_id, r.noise_kind) for r in repair.noise().collect()} <= {(1, "page_number")} and repair.paragraphs().count() == 2


def test_kept_columns_of_counts(spark):
    df = spark.createDataFrame([(1, "ab cd " * 30, "x", None), (2, "a", None, 5), (3, None, "z", 6)], "id long, t string, s string, tokens int")
    got = {r.id: (r.tokens, r.s) for r in tokens.token_counts(df, "id", "t", "estimate", limit=20, keep=["s"]).collect()}
    assert got == {1: (45, "x"), 2: (0, None), 3: (None, "z")}
