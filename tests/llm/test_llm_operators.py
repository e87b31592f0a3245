"""The operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers as P
from plumbline.llm import bpe, chat_format, decontamination, html_text, line_dedup, ngram_join, quality_rules, queries, secret_scan, token_counts, toxicity
from plumbline.llm.components import connected_components

DOC = "doc_id long, text string"
ODD = [None, "", " ", " \n\x0b \x0c\r\t ", "a", "\x85a\xa0b c", "x" * 20_000, "word " * 5_000, "é😀日本 ñ", "a\n\nb\n", "\x00\x01"]


def docs(spark, texts, extra=False):
    df = spark.createDataFrame(list(enumerate(texts)), DOC).repartition(3)
    return df.withColumns({"ids": F.lit("mine"), "n_words": F.lit("x"), "codes": F.lit(1), "cls": F.lit(2), "__x": F.lit(None).cast("string")}) if extra else df


def nothing(spark):
    return spark.createDataFrame([], DOC)


# 1
def greedy(word, pieces):
    i = n = 0
    while i < len(word):
        k = next((k for k in range(min(20, len(word) - i), 0, -1) if word[i : i + k] in pieces), 0)
        n += 1 if k else len(word[i].encode())
        i += k or 1
    return n


def test_token_counts(spark):
    rnd = random.Random(1)
    pieces = {"▁", "▁a", "▁ab", "b", "bc", "abcd", "cde", "▁abcde", "é", "日", "dd"} | {"".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 6))) for _ in range(60)}
    texts = ODD + [" ".join("".join(rnd.choice("abcdé日x▁") for _ in range(rnd.randint(1, 12))) for _ in range(rnd.randint(0, 9))) for _ in range(300)]
    got = token_counts.token_counts(docs(spark, texts, True), sorted(pieces)).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert (r.n_words, r.n_tokens) == (len(words), sum(greedy("▁" + w, pieces) for w in words)), t
    assert got[0].ids == "mine" and token_counts.token_counts(nothing(spark), ["a"]).count() == 0


# 2
def test_preference_pairs(spark):
    schema = "pair_id long, side string, turn long, role string, text string"
    rows = [(1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "yo"), (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "no"), (1, "rejected", 2, "user", None)]
    rows += [(2, "chosen", 0, "user", "a"), (3, "rejected", 0, None, "b"), (4, "chosen", 0, "user", "s"), (4, "rejected", 0, "user", "s"), (4, "rejected", 1, "assistant", "t"), (None, "chosen", 0, "user", "x"), (5, "other", 0, "user", "x")]
    got = {r.pair_id: r for r in chat_format.preference_pairs(spark.createDataFrame(rows, schema).withColumn("prompt", F.lit(1))).collect()}
    assert set(got) == {1, 2, 3, 4}
    one = got[1]
    assert one.n_common == 1 and one.prompt == "<|im_start|>user\nhi<|im_end|>\n" and one.chosen_text == "<|im_start|>assistant\nyo<|im_end|>\n"
    s = one.chosen_spans[0]
    assert one.chosen_text[s.start : s.end] == "yo<|im_end|>" and one.rejected_text.endswith("<|im_start|>user\n<|im_end|>\n") and len(one.rejected_spans) == 1
    assert got[2].rejected_text is None and got[2].prompt == "" and got[3].chosen_text is None and got[3].n_common == 0
    assert got[4].chosen_text == "" and got[4].n_common == 1
    assert chat_format.preference_pairs(spark.createDataFrame([], schema)).count() == 0


def test_preference_pairs_with_ties_repeats_and_long_turns(spark):
    long = "x" * 300_000
    rows = [(1, side, turn, role, text) for side in ("chosen", "rejected") for turn, role, text in ((0, "user", "b"), (0, "user", "a"), (1, "assistant", long), (1, "assistant", long))]
    rows += [(1, "rejected", 2, "user", "more"), (2, "chosen", 0, None, None), (2, "chosen", 0, None, None)]
    schema = "pair_id long, side string, turn long, role string, text string"
    one, other = (sorted(map(str, chat_format.preference_pairs(spark.createDataFrame(r, schema).repartition(n)).collect())) for n, r in ((1, rows), (5, rows[::-1])))
    assert one == other and len(one) == 2  # ties follow role and text, so the order of rows doesn't show
    held = {r.pair_id: r for r in chat_format.preference_pairs(spark.createDataFrame(rows, schema)).collect()}
    assert held[1].n_common == 4 and held[1].prompt.count(long) == 2 and held[1].prompt.index("a<") < held[1].prompt.index("b<") and held[1].chosen_text == ""


# 3
def test_bpe_round_trip(spark):
    import tiktoken

    ranks = bpe.read_ranks(spark, P.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(3)
    texts = ODD + ["<|endoftext|> it's 123 !!", "ab" * 400, "日本語" * 99] + ["".join(rnd.choice("abcdeéß日 ▁ñ😀!?'\n\t12\x85\xa0\x1c") for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    df = docs(spark, texts, True)
    got = bpe.bpe_decode(bpe.bpe_encode(df, ranks, P.PATTERN), ranks).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        assert r.ids == enc.encode_ordinary(t or "") and bytes(r.decoded) == (t or "").encode() and r.text == t and r.codes == 1
    both = bpe.bpe_encode(df, ranks, P.PATTERN, keep_text=False, decoded_col="__x").select("doc_id", "__x").collect()
    assert {r.doc_id: bytes(r["__x"]).decode() for r in both} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.bpe_encode(nothing(spark), ranks, P.PATTERN).count() == 0


def test_long_merges_equal_short_ones():
    ranks = bpe.read_ranks(None, P.path("byte_bpe_multi_50k.tiktoken"))
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(4)
    for _ in range(100):
        w = "".join(rnd.choice("etaoinsh ") for _ in range(rnd.randint(2, 300)))
        if w.encode() not in ranks:
            assert bpe.merge_long(w.encode(), ranks) == enc.encode_ordinary(w)


def test_merge_tables_hold_every_pair_and_no_other():
    rnd = random.Random(5)
    ranks = {bytes([i]): i for i in range(256)}
    while len(ranks) < 900:
        ranks.setdefault(rnd.choice(list(ranks)) + rnd.choice(list(ranks)), len(ranks))
    d, e = bpe.merge_tables(ranks)
    for a, i in ranks.items():
        found = e[d[i] + np.arange(len(ranks) + 1)] ^ i << bpe.ID_BITS
        held = {j: ranks[a + b] for b, j in ranks.items() if a + b in ranks}
        assert {j: int(x) for j, x in enumerate(found) if x < bpe.NONE} == held
    with pytest.raises(ValueError):
        bpe.merge_tables({b"a": 0})


def test_bpe_folds_words_of_any_length_and_moves_no_rows(spark):
    import tiktoken

    ranks = {bytes([i]): i for i in range(256)}
    rnd = random.Random(6)
    for _ in range(60):
        ranks.setdefault(rnd.choice(["a", "b", "ab", "ba", "aa", "aab"]).encode() + rnd.choice(["a", "b", "ba", "bb", "é"]).encode(), len(ranks))
    enc = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=(ranks := {t: i for i, t in enumerate(ranks)}), special_tokens={})
    texts = [" ".join("".join(rnd.choice("aabé") for _ in range(n)) for n in (1, 2, 3, 126, 127, 128, 129, 130, 300)) for _ in range(20)] + ["", None, "\n\n"]
    df = bpe.bpe_encode(docs(spark, texts), ranks, r"\S+|\s+")
    for r, t in zip(df.orderBy("doc_id").collect(), texts, strict=True):
        assert r.ids == enc.encode_ordinary(t or "")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.index("FileScan") < plan.index("Exchange hashpartitioning")  # the ids go to the blocks of rows, which stay


def nodes(plan):
    """The physical nodes of a plan that ran."""
    name = plan.getClass().getSimpleName()
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else []
    yield name, plan
    for x in inner or [plan.children().apply(i) for i in range(plan.children().size())]:
        yield from nodes(x)


def test_bpe_copies_its_tables_seldom_and_bounds_batches(spark, monkeypatch):
    import tiktoken

    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"ba": 257, b"abba": 258}
    enc = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    rnd, key, during, write = random.Random(7), "spark.sql.execution.arrow.maxBytesPerBatch", [], bpe.materialize_buckets
    texts = [" ".join("".join(rnd.choice("abc") for _ in range(rnd.choice((3, 9, 140)))) for _ in range(30)) for _ in range(60)] + [None, ""]
    monkeypatch.setattr(bpe, "materialize_buckets", lambda *a: during.append(int(spark.conf.get(key))) or write(*a))
    before = spark.conf.get(key)
    # the last: rows of a few words, an epoch for each block of a row, words forgotten again and again
    for limits in ({}, {"WORDS_AT_ONCE": 7}, {"USED_AT_ONCE": 1}, {"WORDS_AT_ONCE": 3, "USED_AT_ONCE": 20, "FOLDED_WORDS": 40, "EPOCH_WORDS": 10, "BLOCK_CHARS": 100}):
        for k, v in limits.items():
            monkeypatch.setattr(bpe, k, v)
        df = bpe.bpe_encode(docs(spark, texts).repartition(20), ranks, r"\S+|\s+")
        assert {r.doc_id: r.ids for r in df.collect()} == {i: enc.encode_ordinary(t or "") for i, t in enumerate(texts)}
        if not limits:  # a row holds the words and epochs of a task, not those of one epoch and class
            (joined,) = (x.metrics().apply("numOutputRows").value() for name, x in nodes(df._jdf.queryExecution().executedPlan()) if name == "BroadcastNestedLoopJoinExec")
            assert 0 < joined <= 8
    assert during == [bpe.BATCH_BYTES] * 4 and spark.conf.get(key) == before


# 4
def base(t):
    w, lines, seen, dup = re.findall(r"[^\x20\x09-\x0D]+", t or ""), (t or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), dup, len(covered)


def test_base_features(spark):
    rnd = random.Random(4)
    texts = ODD + ["\n".join(" ".join(rnd.choice(["a", "b", "c#", "<d>", "é"]) for _ in range(rnd.randint(0, 6))) for _ in range(rnd.randint(0, 8))) for _ in range(200)]
    got = quality_rules.base_features(docs(spark, texts, True)).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(t), t


def test_decision_list_finds_planted_rules(spark):
    rnd = random.Random(5)
    good = lambda: " ".join(f"w{rnd.randint(0, 9999)}" for _ in range(80))
    texts = [good() if i % 3 else good().replace(" ", "# ") if i % 2 else good().upper().replace("W", "ÄÖ") for i in range(300)]
    df = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(bool(i % 3))) for i in range(300)] + [(7, None), (None, 1)], "doc_id long, quality int")
    rules = quality_rules.learn_quality_rules(df, labels)
    out = quality_rules.quality_verdicts(df, rules).collect()
    assert rules and all(r.kept == bool(r.doc_id % 3) for r in out)
    assert quality_rules.learn_quality_rules(df, labels.limit(0)) == []
    kept = quality_rules.quality_verdicts(docs(spark, ODD), []).where("kept").collect()
    assert [r for r in kept if r.n_words < 50] == []


def test_columns_of_the_callers_own_stay(spark):
    df = docs(spark, ["a b c"] * 3 + [None]).withColumns({"f_words": F.lit("mine"), "__pl_x": F.lit(1)})
    out = quality_rules.quality_verdicts(df, [[quality_rules.Condition("f_words", False, 2.0)]])
    assert {(r.f_words, r["__pl_x"], r.kept) for r in out.collect()} == {("mine", 1, False)} and out.count() == 4


# 5
def test_lexicon_against_brute_force():
    rnd = random.Random(55)
    word = lambda n: "".join(rnd.choice("abc") for _ in range(n))
    for _ in range(60):
        weights = {word(rnd.randint(1, 4)) + rnd.choice(["", "", "|"]): 1.0 for _ in range(12)}
        text = " ".join(word(rnd.randint(1, 7)) for _ in range(40)).replace("ab ", "ab-")
        want = []
        for m in re.finditer("[a-c]+", text):
            fits = [t for t in weights if "|" not in t and m[0].startswith(t)] + [t for t in weights if t == m[0] + "|"]
            if fits:
                want.append((m.start(), m.end(), max(fits, key=lambda t: (t[-1] == "|", len(t)))))
        assert toxicity.Lexicon(weights).terms(text) == want


def test_toxicity_of_null_ids_and_repeated_rows(spark, tmp_path):
    rows = [(1, "some text"), (1, "some text"), (None, "some text"), (None, None), (2, "")]
    spark.createDataFrame(rows, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1), (None, 1), (1, 0)], "doc_id long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    got = queries.op5_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == 5 and all(r.held_out is not None and 0 <= r.score <= 1 for r in got)
    assert {r.held_out for r in got if r.doc_id is None} == {True}


def test_folding():
    assert toxicity.fold("M0R0N іdiоt Ｓtupid 2024 $cum!") == "moron idiot stupid 2024 scum!"


def test_lexicon_learns_terms_and_exceptions(spark):
    rnd = random.Random(6)
    plain = lambda n: [f"w{rnd.randint(0, 300)}ord" for _ in range(n)]
    texts, labels = [], []
    for i in range(400):
        words, toxic = plain(rnd.randint(20, 200)), i % 4 == 0
        if toxic:
            words[3] = rnd.choice(["zugwump", "zugwumps", "krotz"])
        elif i % 4 == 1:
            words[5:7] = ["garden", "krotzplant"]
        texts.append(" ".join(words))
        labels.append((i, int(toxic)))
    df = docs(spark, texts + ["a zugwumр b", "", None])
    lexicon = toxicity.learn_lexicon(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.toxicity(df, lexicon, hits_col="hits").collect()}
    assert "zugwump" in lexicon.weights and "krotz|" in lexicon.weights and all((got[i] >= 0.5) == bool(y) for i, y in labels)
    assert got[400] >= 0.5 and got[401] == got[402] == 0.0 and all(0 <= v <= 1 for v in got.values())
    lex = toxicity.Lexicon({"krotz": 3.0}, frozenset(["garden krotz"]))
    assert lex.hits("the garden krotz") == [] and lex.hits("a krotz garden") == ["krotz"]
    whole = toxicity.Lexicon({"krotz|": 3.0, "krot": 1.0})
    assert whole.hits("krotz, krotzplant xkrotz") == ["krotz|", "krot"]
    assert toxicity.learn_lexicon(df, spark.createDataFrame([], "doc_id long, toxic int")).weights == {}


def test_lexicon_has_no_limit_of_terms(spark):
    rnd = random.Random(12)
    many = " ".join("".join(rnd.choice("abcdefghij") for _ in range(12)) for _ in range(26_000))  # 10 beginnings each
    phrases = " ".join(f"krotz p{i:05d} ." for i in range(10_500)) + " krotz zlast"
    texts = [many + " zzugwump"] * 3 + ["a krotz b"] * 17 + [phrases] * 3 + ["plain words"] * 40
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(63)], "doc_id long, toxic int")
    lexicon = toxicity.learn_lexicon(docs(spark, texts), labels)
    assert any("zzugwump".startswith(t.rstrip("|")) for t in lexicon.weights)
    assert "krotz zlast" in lexicon.exceptions and len(lexicon.exceptions) > 10_000


# 6
def test_suffix_array():
    rnd = random.Random(7)
    for _ in range(100):
        x = np.array([rnd.randint(0, 2) for _ in range(rnd.randint(1, 40))])
        order, shared = html_text.suffix_array(x)
        want = sorted(range(len(x)), key=lambda i: list(x[i:]))
        assert list(order) == want
        for j in range(1, len(x)):
            u, v = list(x[want[j - 1] :]), list(x[want[j] :])
            k = next((k for k in range(min(len(u), len(v))) if u[k] != v[k]), min(len(u), len(v)))
            assert shared[j] == k


PAGE = '<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body><header>top</header><nav><ul><li>m</li></ul></nav><div class="ad">buy</div><article><h1>Head &amp; line</h1><p><b>One\n  two<br>three<br><p>Four&#33; &lt;x&gt;</p><aside>side</aside><form>f</form><div id="comments"><p>nice</p></div><p>Last</article><footer>f</footer></body></html>'


def test_article_and_cut_markup():
    main = lambda h: [t for t, z, _ in html_text.read_blocks(h) if z == html_text.MAIN]
    assert main(PAGE) == ["Head & line", "One two three", "Four! <x>", "Last"]
    assert main(PAGE[: PAGE.index("Last") + 2]) == ["Head & line", "One two three", "Four! <x>", "La"]
    assert main("<article><p>a &amp b &am") == ["a & b &am"] and main("<article><p>a<p") == ["a"] and main("") == main(None) == []
    assert main("<article><p title='a>b'>x</p><p>1 < 2</p></article>") == ["x", "1 < 2"]


def test_wrappers_do_not_hide_the_article():
    main = lambda h: [t for t, z, _ in html_text.read_blocks(h) if z == html_text.MAIN]
    text = "<p>a text</p><div class='ad'>buy</div><aside>side</aside>"
    for page in ("<body class='has-sidebar'><article>{}</article>", "<body class='sidebar'><main>{}</main>", "<div id='page' class='nav-open'><article>{}</article></div>", "<article class='post comments-open'>{}</article>", "<div class='widget'><div role=main>{}</div></div>", "<body><article class='comments'>{}</article>", "<div class='modal'><div class='social'><article>{}</article></div></div><p>x</p>"):
        assert main(page.format(text)) == ["a text"], page
    assert main(f"<article>{text}</article><div id='comments'><article><p>nice</p></article></div><aside><article>more</article></aside>") == ["a text"]
    zone = lambda c: html_text.read_blocks(f"<div class='{c}'>x</div>")[0][1]
    assert [zone(c) for c in ("ad", "x footer-links", "cookie-banner", "has-sidebar", "nav-open", "post comments-open")] == [2, 2, 2, 1, 1, 1]


def test_host_boilerplate_goes(spark):
    note = "we use small files to remember what you like"
    html = lambda i: f"<html><body><div>{note}</div><div>{' '.join(f'own{i}x{j}' for j in range(30))}</div></body></html>"
    rows = [(i, "http://h.example/a", html(i)) for i in range(6)] + [(10, "http://g.example/", html(10)), (11, None, None), (12, "x", ""), (13, "http://k.example", PAGE), (13, "http://k.example", PAGE)]
    rows += [(20 + i, "http://c.example/x", "<body><p>" + "one and the same copied text here</p></body>") for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(5))
    got = [(r.page_id, r.text, r.n_chars) for r in html_text.main_text(df).collect()]
    by = dict((i, t) for i, t, _ in got)
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    assert all(note not in by[i] and f"own{i}x29" in by[i] for i in range(6)) and note in by[10]
    assert by[11] == by[12] == "" and by[13].count("\n") == 3 and by[20] == "one and the same copied text here"
    assert html_text.main_text(df.limit(0)).count() == 0


def test_boilerplate_is_counted_over_the_whole_host(spark):
    note, rare, every = "we use small files to remember what you like", "two pages alone carry this other short note here", "all of the pages show this line below the text"
    html = lambda i: "<body>" + "".join(f"<div>{x}</div>" for x in [note] * (i % 150 == 0) + [rare] * (i in (5, 205)) + [every]) + f"<div>{' '.join(f'own{i}x{j}' for j in range(12))}</div></body>"
    df = spark.createDataFrame([(i, "http://h.example/a", html(i)) for i in range(386)], "page_id long, url string, html string")
    want = {i: "\n".join([rare] * (i in (5, 205)) + [" ".join(f"own{i}x{j}" for j in range(12))]) for i in range(386)}
    for dealt in (df.coalesce(1), df.repartition(7)):  # 0, 150 and 300 never share 128 neighbours; 384 and 385 are left over
        assert {r.page_id: r.text for r in html_text.main_text(dealt).collect()} == want


# 7
def dedup(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(line_dedup.A_Z, line_dedup.a_z))
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(d)
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and d != max(holders[key(x)]))]
        out[d] = (len(lines), len(lines) - len(stay), "\n".join(stay))
    return out


@pytest.mark.parametrize("parts", [1, 5, 30])
def test_line_dedup(spark, parts):
    rnd = random.Random(parts)
    pool = [f"Line number {i} with enough text é" for i in range(30)] + ["short", "", "  A LINE that all of them repeat "] * 4
    texts = ODD + ["\n".join(rnd.choice(pool) + rnd.choice(["", " ", "\t"]) if rnd.random() < 0.7 else f"own {i} {j} xxxxxxxxxxxxxxxx" for j in range(rnd.randint(0, 12))) for i in range(300)]
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.doc_id: (r.n_lines, r.n_dropped, r.text or "") for r in line_dedup.line_dedup(docs(spark, texts, True)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert got == dedup(list(enumerate(texts)))


def test_line_dedup_without_rows_or_ids(spark):
    assert line_dedup.line_dedup(nothing(spark)).count() == 0
    rows = [(None, "a line of more than twenty letters")] * 3 + [(1, "a line of more than twenty letters")] * 2
    got = line_dedup.line_dedup(spark.createDataFrame(rows, DOC)).collect()
    assert len(got) == 5 and all(r.n_dropped == 0 for r in got)


# 8
def test_contamination(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7)))
    items = [" ".join([word() for _ in range(12)] + ["has", "12", "kg", "and", "Anna", "takes", "5", "of", "12"] + [word() for _ in range(6)]) for _ in range(5)] + ["too few", None]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("size", F.lit(1))
    noise = lambda n: " ".join(word() for _ in range(n))
    swapped = items[1].replace("12", "77").replace("Anna", "Berta").replace(" 5 ", " 9 ")
    wrong = items[2].replace("has 12", "has 77").replace(" 5 ", " 9 ")  # 12 would stand for 77 and 12
    texts = [f"{noise(30)} {items[0]} {noise(9)}", f"{noise(5)}\n{swapped.upper()[:0]}{swapped}", wrong, noise(200), None, "", items[3].upper().replace("12", "12"), f"{items[4]} {noise(3)} {items[0]}", "x " * 5000]
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(docs(spark, texts, True), bench).collect()}
    assert {(0, 0), (1, 1), (7, 4), (7, 0)} <= set(got) and got[1, 1].n_changed == 3 and got[0, 0].n_changed == 0
    assert not {d for d, _ in got} & {2, 3, 4, 5, 8}
    assert decontamination.contaminated(nothing(spark), bench).count() == 0 == decontamination.contaminated(docs(spark, texts), bench.limit(0)).count()


def test_contamination_keeps_verbatim_windows(spark):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    twice = " ".join(words[:10] + ["12"] + words[10:30] + ["12"] + words[30:40] + ["7"])
    clash = " ".join(words[:4] + ["12"] + words[4:8] + ["12"] + words[8:40])
    long = " ".join(words[:59])
    bench = spark.createDataFrame([(0, twice), (1, clash), (2, long)], "item_id long, text string")
    texts = [twice.replace("12", "77", 1), clash.replace("12", "77", 1), "so " + " ".join(words[20:40]) + " no", "so " + " ".join(words[20:39]) + " no"]
    got = {(r.doc_id, r.item_id): (r.n_windows, r.n_matched, r.n_changed) for r in decontamination.contaminated(docs(spark, texts), bench.where("item_id < 2")).collect()}
    assert got[0, 0] == (36, 36, 1)  # one mention of two changed, but no window holds both
    assert got[1, 1] == (35, 30, 0)  # the windows with a 12 that are changed clash
    got = {(r.doc_id, r.item_id): r.n_matched for r in decontamination.contaminated(docs(spark, texts[2:]), bench.where("item_id = 2")).collect()}
    assert got == {(0, 2): 13}  # 20 words are enough, 19 aren't


def test_contamination_whatever_stands_before_an_item(spark):
    items = ["What is the capital of France?", "Minutes pass like slow wide rivers", "Where do the Berlin trams stop when it rains at night"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [f"Question 12\n{items[0]}", f"a heading {items[0]}", f"Part 5\n{items[1]}", f"see the {items[2]}".replace(" trams", "\ntrams"), f"and so on\n{items[0]} {items[1]}", "What is the capital of a state"]
    got = {(r.doc_id, r.item_id): (r.n_matched, r.n_changed) for r in decontamination.contaminated(docs(spark, texts), bench).collect()}
    assert got == {(0, 0): (1, 0), (1, 0): (1, 0), (2, 1): (1, 0), (3, 2): (4, 0), (4, 0): (1, 0), (4, 1): (1, 0)}


def test_contamination_of_numbers_and_short_items(spark):
    numbers = " ".join(map(str, range(100, 130)))
    items = [numbers, "Paris", "two plus two", "The 12 sheep and the 5 goats of Anna graze near the old mill by noon", ".", "Anna 12 kg Berta 5 km Carla 9 m Dora"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    other = " ".join(map(str, range(500, 560)))
    texts = [other, f"a table {numbers} end", " paris. ", "paris is large", "Two plus two!", "two plus three", items[3].replace("12", "40").replace("Anna", "Olga"), f"{items[3]} {items[3].replace('12', '40')}", None, ".", "Emil 1 kg Fritz 2 km Gerd 3 m Hans", items[5]]
    rows = docs(spark, texts).unionByName(spark.createDataFrame([(None, "Paris"), (2, "Paris"), (2, "Paris")], DOC))
    got = {(r.doc_id, r.item_id): (r.n_matched, r.n_changed) for r in decontamination.contaminated(rows, bench).collect()}
    assert got == {(1, 0): (23, 0), (2, 1): (1, 0), (4, 2): (1, 0), (6, 3): (9, 2), (7, 3): (9, 0), (11, 5): (3, 0)}


def test_windows_share_the_hash_of_what_follows_their_first_token():
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)]
    for size in range(5, 9):
        one = decontamination.canonical(" ".join(words), decontamination._Words())
        for at in (0, 1, 20, 40 - size):
            for changed in range(-1, size):
                cut = [w if i != changed else "other" for i, w in enumerate(words[at : at + size])]
                two = decontamination.canonical(" ".join(cut), decontamination._Words())
                a, b = (decontamination.tail_hashes(t, size) for t in (one, two))
                assert (a[at] == b[0]) == (changed < 1)
                x, y = (decontamination.window_hashes(t, size, h, decontamination._plain_words(t, size)) for t, h in ((one, a), (two, b)))
                assert (x[at] == y[0]) == (changed < 0)


def brute_contamination(texts, items):
    """Items whose windows of 8 words stand in a text to at least a half, or 20 words in a row; no placeholders."""
    out = set()
    for d, t in enumerate(texts):
        held = set(zip(*[t.split()[i:] for i in range(8)]))
        run = set(zip(*[t.split()[i:] for i in range(20)]))
        for k, item in enumerate(items):
            w = item.split()
            windows = list(zip(*[w[i:] for i in range(8)]))
            if 2 * sum(x in held for x in windows) >= len(windows) or any(x in run for x in zip(*[w[i:] for i in range(20)])):
                out.add((d, k))
    return out


def test_contamination_against_brute_force(spark):
    rnd = random.Random(88)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    items = [" ".join(word() for _ in range(rnd.randint(9, 60))) for _ in range(12)]
    texts = []
    for _ in range(150):
        w = items[rnd.randrange(12)].split()
        a = rnd.randrange(len(w))
        cut = w[a : a + rnd.randint(1, 60)]
        if rnd.random() < 0.5:
            cut[rnd.randrange(len(cut))] = word()
        texts.append(" ".join([word() for _ in range(rnd.randint(0, 20))] + cut + [word() for _ in range(rnd.randint(0, 20))]))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs(spark, texts), bench).collect()}
    assert got == brute_contamination(texts, items) and len(got) > 30


# 9
def secrets(t):
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secrets(spark):
    rnd = random.Random(9)
    bits = ['token = "cb1a9fee807a05366fcb8b6c95c7c565ede51a72"', "AKIA" + "A1" * 8, "AKIA1", "secret: token", "PassWord='abc", "api_key=xyzxyz", "deadbeef" * 3, "token=abc token=abcdef", "é😀", "plain"]
    texts = ODD + [rnd.choice([" ", "\n", ""]).join(rnd.choice(bits) for _ in range(rnd.randint(0, 6))) for _ in range(300)]
    got = secret_scan.secret_spans(docs(spark, texts, True)).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        assert [(s.start, secret_scan.KINDS.index(s.kind), s.end) for s in r.secret_spans if s.kind in secret_scan.KINDS[:3]] == secrets(t or ""), t
    assert secret_scan.secret_spans(nothing(spark)).count() == 0


def test_parts_need_each_other():
    key = "aB3dE5gH7jK9mN1pQ3sT"
    kinds = lambda t: [secret_scan.KINDS[k] for _, k, _ in sorted(secret_scan.linked_spans(t, secret_scan.base_spans(t)))]
    assert kinds(f"value {key} alone") == kinds("client_id = someone") == kinds("see https://a.example/x") == []
    assert kinds(f"client_id = someone\nvalue {key}") == ["identifier", "secret"]
    assert kinds(f"client_id = someone\nvalue {key} at https://a.example/x") == ["identifier", "secret", "endpoint"]
    assert kinds(f"client_id = someone\n\nvalue {key}") == [] and kinds(f"client_id = someone {'x ' * 400} {key}") == []


def test_secrets_of_any_length_and_two_classes():
    kinds = lambda t: [secret_scan.KINDS[k] for _, k, _ in sorted(secret_scan.linked_spans(t, secret_scan.base_spans(t)))]
    rnd = random.Random(10)
    long = "".join(rnd.choice("abcXYZ0189ghiJKL+/") for _ in range(700))
    for key in (long[:129], long + "==", "k3v9zq7x1m5w8t2r6y4u0p3n9b7c5j1h"):
        assert kinds(f"client_id = someone\nvalue {key}") == ["identifier", "secret"], key
        assert kinds(f"{key} at https://a.example/x") == ["secret"] and kinds(f"value {key} alone") == []
    assert kinds("client_id = someone\nvalue " + "xy1" * 60) == kinds("client_id = someone\n" + "g" * 300) == kinds(f"client_id = someone\n{long}===") == []


# 10
def components(texts):
    sets = {}
    for d, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for d in sets:
        for e in range(d):
            both = len(sets[d] & sets[e])
            if both and 100 * both >= 75 * (len(sets[d]) + len(sets[e]) - both):
                a, b = top(d), top(e)
                up[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), top(d)) for d in sets}


@pytest.mark.parametrize("frequent", [1, 3, 32])
def test_similar_components(spark, frequent):
    rnd = random.Random(frequent)
    words = [f"w{i}" for i in range(200)]
    passage, texts = [rnd.choice(words) for _ in range(60)], list(ODD)
    for _ in range(40):
        own = [rnd.choice(words) for _ in range(rnd.choice([1, 3, 5, 6, 7, 8, 10, 20, 50, 120]))] + (passage if rnd.random() < 0.3 else [])
        for _ in range(rnd.choice([1, 2, 5, 20])):
            x = list(own)
            for _ in range(rnd.randint(0, max(1, len(x) // 25))):
                x[rnd.randrange(len(x))] = rnd.choice(words)
            texts.append(" ".join(x))
    texts += ["A b C", "a B c"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(docs(spark, texts, True), frequent_df=frequent).collect()}
    assert got == components(texts)


def test_similar_components_without_rows_or_ids(spark):
    assert ngram_join.similar_components(nothing(spark)).count() == 0
    assert ngram_join.similar_components(spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f")], DOC)).count() == 3


def test_connected_components(spark):
    rnd = random.Random(11)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rnd.randint(0, 40), 100 + rnd.randint(0, 40)) for _ in range(30)] + [(7, 7)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    table = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(table).collect()}
    assert got == {r.node: r.component for r in connected_components(table, local_edges=0).collect()}
    assert got == {x: find(x) for x in up}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
