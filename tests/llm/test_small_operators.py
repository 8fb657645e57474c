"""Operators that work text by text, held against plain versions."""

import hashlib
import random
import re

import pytest

from pitchload.llm import bm25_decon, html_template, pii_anchor, sp_dropout
from tests.conftest import SF001

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(t):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, t):
            d = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                  "card": lambda: 13 <= len(d) <= 19 and pii_anchor.luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def texts(spark):
    return [r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]


def test_pii_base_spans(spark):
    r = random.Random(1)
    noise = ["".join(r.choice("a@.@+1234567890 -().b%_é") for _ in range(r.randint(0, 80))) for _ in range(5000)]
    for t in texts(spark) + noise + ["1" * 3000, "1." * 500, "4111 1111 1111 1111", "a@b.c@d.ef"]:
        assert [s for s in pii_anchor.find(t) if s[0] in pii_anchor.BASE] == base_spans(t), t


def test_pii_added_spans_and_redaction():
    t = 'IBAN: DE89 3704 0044 0532 0130 00, token = "abc123def" see http://u:pw@host.org/x, account no. 12345678, accounting 99999999'
    assert [t[a:b] for k, a, b in pii_anchor.find(t) if k in ("account", "address")] == \
        ["http://u:pw@host.org", "DE89 3704 0044 0532 0130 00", "abc123def", "12345678"]
    assert pii_anchor.redact("mail x.y@z.org now", pii_anchor.find("mail x.y@z.org now")) == "mail [EMAIL] now"


def plain_accounts(t):
    """Identifiers behind cues (no IBAN in `t`), by loops over characters."""
    out, word = [], set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    for a in range(len(t)):
        for cue in pii_anchor.CUES:
            b = a + len(cue)
            if t[a:b] not in (cue, cue.upper(), cue.capitalize()) or t[a - 1:a].isalnum() or t[b:b + 1].isalnum():
                continue
            i = b
            while t[i:i + 1] in (" ", "\t"):
                i += 1
            for name in ("number", "no", "nr", "id"):
                after = t[i + len(name):i + len(name) + 1]
                if t[i:i + len(name)].lower() == name and not (after.isalnum() or after == "_"):
                    i += len(name) + (after == ".")
                    break
            else:
                i = b
            for some in (" \t", ":=#", " \t", "\"'"):
                while i < len(t) and t[i] in some:
                    i += 1
                    if some[0] not in " ":
                        break
            j = i
            while j < len(t) and (t[j] in word or t[j] in "_-" or (j > i and t[j] in "./+=")):
                j += 1
            while j > i and t[j - 1] in "./+":
                j -= 1
            if not any(c.isalpha() for c in t[i:j]):
                j = i
                while j < len(t) and t[j] in "0123456789-":
                    j += 1
                if t[j:j + 1] == "_":
                    continue
            if j - i >= 6 and any(c.isdigit() for c in t[i:j]):
                out.append((i, j))
    return out


def outermost(spans):
    """Spans that lie in no other one (a cue inside an identifier adds nothing)."""
    return sorted({s for s in spans if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in spans)})


def test_pii_accounts_against_loops():
    r = random.Random(4)
    bits = ["token", "account", "Account", "SSN", "konto", " ", " ", "  ", ":", "=", "#", "_", "-", ".", "/", "+", '"', "no", "nr.", "id",
            "a1", "x", "12345", "678901", "ghp", "é", ","]
    for _ in range(20_000):
        t = "".join(r.choice(bits) for _ in range(r.randint(1, 14)))
        got = [(a, b) for k, a, b in pii_anchor.find(t) if k == "account"]
        assert outermost(got) == outermost(plain_accounts(t)), t


def test_pii_identifiers_and_schemes_of_any_length():
    def accounts(t):
        return [t[a:b] for k, a, b in pii_anchor.find(t) if k in ("account", "address")]
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.dGVzdA=="
    assert accounts(f"token = {'a1' * 40}, token = ghp_abc123def456; token: {jwt} end") == ["a1" * 40, "ghp_abc123def456", jwt]
    assert accounts("account 12345.67 on account 12.10.2024, token abc123def.") == ["abc123def"]
    assert accounts("token: account 12345678 token=account= 12345678") == ["12345678", "12345678"]
    assert accounts(f"{'long' * 10}+x://u:pw@h.org") == ["long" * 10 + "+x://u:pw@h.org"]
    for t in ("token=" * 200_000, "account" + " " * 200_000 + "é", "a" * 500_000 + "://", "token " * 100_000, "token." * 200_000 + "x"):
        assert accounts(t) == []


def test_pii_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "a", 5), (1, None, "a", 5), (None, "", "b", 0), (2, "x@y.zz", "c", 6)],
                               "doc_id long, text string, pii string, n_chars long")
    got = {(r.doc_id, r.text): r for r in pii_anchor.find_personal_data(df).collect()}
    assert got[1, None].pii.base_sha256 == hashlib.sha256(b"").hexdigest() and got[1, None].pii.redacted is None
    assert got[2, "x@y.zz"].pii.spans == "email:0:6"
    out = sorted(pii_anchor.redacted(df).collect(), key=str)
    assert [(r.text, r.n_chars) for r in out if r.doc_id == 2] == [("[EMAIL]", 7)] and len(out) == 4
    assert pii_anchor.redacted(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def proto():
    with open(sp_dropout.MODEL, "rb") as f:
        return f.read()


ODD = ["", " ", "  a  b \n\nc ", "①ﬁ▁x", "a" * 500, "  " * 50, "\t\r x", "日本語 テキスト" * 30, "the " * 3 + "\n \n", "\x00 ▁▁"]


def test_tokens_without_dropout_are_the_models(spark, proto):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
    plain = sp_dropout.Codec(proto, dropout=0.0)
    for t in texts(spark) + ODD:
        if "▁" not in t:
            assert plain.encode(t) == sp.encode(t), t


def test_tokens_round_trip_and_vary(spark, proto):
    codec, other = sp_dropout.Codec(proto), sp_dropout.Codec(proto, seed=8)
    some = texts(spark)
    for t in some + ODD:
        for v in (0, 5):
            assert codec.decode(codec.encode(t, v)) == t
    ways = [tuple(codec.encode(some[0], v)) for v in range(8)]
    assert len(set(ways)) > 1 and other.encode(some[0]) != list(ways[0]) and sp_dropout.Codec(proto).encode(some[0]) == list(ways[0])


def plain_merges(sp, score, codec, chunk, key):
    """Merge loop over strings; only the keyed hash is the operator's. Returns piece ids."""
    symbols = [("▁" if c == " " else c, i, i + 1) for i, c in enumerate(chunk)]
    known = [x[0] in score and chunk[x[1]] != "▁" for x in symbols]
    skipped = set()
    while True:
        can = [(-score[l[0] + r[0]], l[1], k) for k, (l, r) in enumerate(zip(symbols, symbols[1:]))
               if known[l[1]] and known[r[1]] and l[0] + r[0] in score and (l[1], r[1], r[2]) not in skipped]
        if not can:
            break
        k = min(can)[2]
        l, r = symbols[k:k + 2]
        if codec._skip(key, l[1], r[1], r[2]):
            skipped.add((l[1], r[1], r[2]))
        else:
            symbols[k:k + 2] = [(l[0] + r[0], l[1], r[2])]
    out = []
    for text, at, _ in symbols:
        out += [sp.piece_to_id(text)] if known[at] else [sp.piece_to_id(f"<0x{b:02X}>") for b in chunk[at].encode()]
    return out


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5])
def test_tokens_against_a_plain_merge_loop(spark, proto, dropout, monkeypatch):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
    score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size())
             if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    monkeypatch.setattr(sp_dropout, "CACHE", 100)              # generations change all the time
    codec = sp_dropout.Codec(proto, dropout=dropout)
    some = [t[:2000] for t in texts(spark)[:25]] + ODD + ["▁▁a ①②a " + "a" * 64 + " " + "international" * 12]
    got = codec.encode_many(some, list(range(len(some))))
    for d, (t, ids) in enumerate(zip(some, got)):
        chunks = sp_dropout._chunks.findall(" " + t) if t else []
        keys = codec.keys([d], [len(chunks)]).tolist()
        assert ids.tolist() == [i for c, k in zip(chunks, keys) for i in plain_merges(sp, score, codec, c, k)], t


def test_occurrences_of_a_word_differ(proto):
    codec = sp_dropout.Codec(proto)
    text = "international " * 300
    chunks = sp_dropout._chunks.findall(" " + text)
    words = codec.chunks(chunks, codec.keys([4], [len(chunks)]))
    assert len(set(words[:300])) > 5 and max(map(words.count, set(words))) > 30
    assert codec.decode(codec.encode(text, 4)) == text and codec.encode(text, 4) != codec.encode(text, 5)


def test_tokens_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 3), (None, "a b", 4), (1, None, 3)], "doc_id long, text string, n_tokens int")
    got = sp_dropout.encode(df)
    rows = got.collect()
    assert sorted(r.n_tokens for r in rows)[:2] == [0, 0] and all(r.lossless for r in rows)
    assert {r.text for r in sp_dropout.decode(got).collect()} == {"", "a b"}
    assert sp_dropout.encode(df.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=/a>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div><article><header><h1>Big &amp; small</h1></header>
<p>One <b>two<br>three</b><p>Four &#8364; five<script>var t="</p>";</script> six<!-- no --><ul><li>a<li>b</ul>
<div class="share">Share</div><form>Name <input></form></article><aside>Side</aside><section id=comments><p>Nice</section><footer>&copy;</footer>"""


def test_main_text_of_a_page():
    assert html_template.main_text(PAGE) == "Big & small\n\nOne two three\n\nFour € five six\n\na\n\nb"
    assert html_template.main_text("plain <i>te</i>xt") == "plain text"
    assert html_template.main_text("<div>" * 3000 + "deep") == "deep"


def test_site_template_goes(spark):
    rows = [(i, f"http://S.org/{i}", f"<body><div class=x><b>Our site</b> since 1999</div><div><p>Story number {i}</p></div></body>") for i in range(30)]
    rows += [(100 + i, f"http://other.org/{i}", f"<div>Our site</div><article><p>Quoted by all</p><p>{i}</p></article>") for i in range(10)]
    rows += [(200, None, None), (201, "x", ""), (202, "http://one.org", "<p>Alone</p>"), (202, "http://one.org", "<p>Alone</p>")]
    df = spark.createDataFrame([(*r, "y", "z") for r in rows], "page_id long, url string, html string, text string, host string")
    got = [(r.page_id, r.text, r.n_chars) for r in html_template.extract(df.repartition(5)).collect()]
    want = [(i, f"Story number {i}", len(f"Story number {i}")) for i in range(30)]
    want += [(100 + i, f"Quoted by all\n\n{i}", 16) for i in range(10)]
    want += [(200, "", 0), (201, "", 0), (202, "Alone", 5), (202, "Alone", 5)]
    assert sorted(got) == sorted(want)
    assert html_template.extract(df.limit(0)).count() == 0


def test_template_of_a_section_of_a_large_host(spark):
    """An unmarked notice on a tenth of a host's pages goes; the text of a page with many urls stays."""
    notice = "<div>Only in this section</div>"
    rows = [(i, f"http://big.org/{i}", f"<body>{notice if i % 10 == 0 else ''}<div>Story number {i}</div></body>") for i in range(300)]
    rows += [(1000 + i, f"http://big.org/copy?{i}", "<body><div>The same page</div></body>") for i in range(15)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_template.extract(df).collect()}
    assert got == {i: f"Story number {i}" if i < 1000 else "The same page" for i, _, _ in rows}


def test_repeated_answers_forms_classes_and_references_stay_or_go(spark):
    text = html_template.main_text
    assert text("<p>A<select><option>q<optgroup label=x><option>r</select> b") == "A b"
    assert text('<article><section class="related-work">Kept</section><figure id="share-prices">Too</figure><p>x</p>'
                '<div class="share-buttons">no</div><div class="site ad-728x90">no</div></article>') == "Kept\n\nToo\n\nx"
    assert text('<div class="nav__item--active">no</div><div id="top">no</div><div class="top-secret">yes</div>') == "yes"
    assert text("AT&am<b>p;</b>T &amp;lt;") == "AT&amp;T &lt;"
    answer = "<div>Yes, it works.</div>"
    rows = [(i, f"http://host.org/{i}", f"<body>{answer if i % 50 == 0 else ''}<div>Question {i}</div></body>") for i in range(600)]
    # a section's notice on one in a hundred of the host's pages, and a page that has many urls in a section of its own
    rows += [(1000 + i, f"http://host.org/shop/{i}", f"<body><div>Shop is closed</div><div>Thing {i}</div></body>") for i in range(6)]
    rows += [(2000 + i, f"http://host.org/copy/{i}", "<body><div>The same</div></body>") for i in range(9)]
    got = {r.page_id: r.text for r in html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i: ("Yes, it works.\n\n" if i % 50 == 0 else "") + f"Question {i}" for i in range(600)}
    assert got == want | {1000 + i: f"Thing {i}" for i in range(6)} | {2000 + i: "The same" for i in range(9)}


def test_templates_against_counts_page_by_page(spark):
    """Which subtrees go, counted in plain Python over random pages (menus and marked elements count too)."""
    r = random.Random(6)
    parts = ["<nav><a>Home</a></nav>", "<div>One</div>", "<div class=ad>Buy</div>", "<section><p>Two</p><p>Two b</p></section>", "<p>Three</p>", "<i>Four</i>"]
    rows = []
    for i in range(240):
        h = r.choice(["a.org", "b.org", "b.org", "b.org"])
        url = f"http://{h}/{r.choice(['x/', 'y/', ''])}{i}"
        body = "".join(p for k, p in enumerate(parts) if r.random() < .015 * (k + 1) * (4 if "x/" in url else 1)) + (f"<p>own {i % 200}</p>" if i % 9 else "")
        rows.append((i, url, body))
    on, pages = {}, {}
    for _, url, body in rows:
        bits = url.split("/")
        sub = html_template.subtrees(body)
        for scope in {bits[2]} | ({"/".join(bits[2:4]) + "/"} if len(bits) > 4 else set()):
            if len(sub) > 1:
                pages.setdefault(scope, set()).add(sub[0])
            for x in sub[1:]:
                on.setdefault((scope, x), set()).add(sub[0])
    template = {k for k, v in on.items() if len(v) >= 5 and (len(v) >= .2 * len(pages[k[0]]) or
                ("/" not in k[0] and len(v) >= 10 and len(v) >= .05 * len(pages[k[0]])))}
    want = {}
    for i, url, body in rows:
        bits = url.split("/")
        scopes = {bits[2], "/".join(bits[2:4]) + "/" if len(bits) > 4 else ""}
        want[i] = html_template.main_text(body, frozenset(x for s, x in template if s in scopes), lists=False)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_template.extract(df, lists=False).collect()} == want
    assert len(template) > 5 and any("/" in s for s, _ in template) and any("Home" in t for t in want.values())
    assert main_text_without(rows) != want


def main_text_without(rows):
    return {i: html_template.main_text(body, lists=False) for i, _, body in rows}


def items(spark):
    return [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]


def index_of(its):
    df, total = {}, 0
    for _, t in its:
        h, _ = bm25_decon.word_hashes([t])
        total += len(h)
        for w in set(h.tolist()):
            df[w] = df.get(w, 0) + 1
    return bm25_decon.Index(its, df, len(its), total / len(its))


def test_wand_retrieves_all_above_the_threshold(spark):
    its = items(spark)
    index = index_of(its)
    scores = {}
    for t, blocks in enumerate(index.postings):
        for posts in blocks.values():
            for k, x in posts:
                scores.setdefault(int(index.terms[t]), []).append((k, x))
    docs = texts(spark)[:120] + [" ".join(t for _, t in its), "", its[0][1].upper()]
    got, _, _ = index.retrieve(docs)
    for i, d in enumerate(docs):
        h = bm25_decon.word_hashes([d])[0].tolist()
        want = {}
        for u in range(0, len(h), bm25_decon.UNIT):
            total = {}
            for w in set(h[u:u + bm25_decon.UNIT * bm25_decon.PASSAGE]):
                for k, x in scores.get(w, ()):
                    total[k] = total.get(k, 0) + x
            for k, s in total.items():
                if s >= 1:
                    want[k] = max(s, want.get(k, 0))
        assert {k: round(s, 6) for k, s in got.get(i, {}).items()} == {k: round(s, 6) for k, s in want.items()}, i


def test_a_question_alone_is_found(spark):
    """Documents that hold only an item's question, whole or cut in two, among words of no item."""
    its = [(k, t) for k, t in items(spark)] + [(9000, "which river is the longest of them all here answer: " + " ".join(f"w{i}" for i in range(60))),
                                               (9001, "tell me why answer: " + " ".join(f"v{i}" for i in range(30)))]
    index = index_of(its)
    pad = " zzpad" * 200 + " "
    for item, text in its:
        words = bm25_decon.split_item(text)[0].split()
        if len(words) >= 25 or item == 9000:
            docs = [pad + " ".join(words) + pad]
            if len(words) >= 30:
                docs.append(" ".join(words[:len(words) // 2]) + pad + " ".join(words[len(words) // 2:]))
            for hit in index.search(docs):
                assert item in {x["item_id"] for x in hit}, item
    assert {x["item_id"] for x in index.search(["Tell me why?"])[0]} == {9001}


def test_decontamination(spark, monkeypatch):
    its = items(spark) + [(9000, None), (9001, ""), (9002, "...")]
    bench = spark.createDataFrame(its + its[:1], "item_id long, text string")
    body = texts(spark)[0][:400]
    rows = [(1, body + " " + its[3][1] + " " + body, "e"), (2, "", "e"), (3, None, "e"), (None, its[5][1], "e"), (5, its[4][1][:60], "e")]
    rows += [(6, "|".join(its[7][1].upper().split()), "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    want = {(1, its[3][0]), (None, its[5][0]), (6, its[7][0])}
    assert want <= {(r.doc_id, r.item_id) for r in bm25_decon.contaminated(docs, bench).collect()}
    stays = bm25_decon.without_test_items(docs, bench)
    assert {r.doc_id for r in stays.collect()} == {2, 3, 5} and stays.columns == docs.columns
    monkeypatch.setattr(bm25_decon, "SHARD_CHARS", 1500)            # several shards
    assert want <= {(r.doc_id, r.item_id) for r in bm25_decon.contaminated(docs, bench).collect()}
    assert bm25_decon.contaminated(docs, bench.limit(0)).count() == 0 and bm25_decon.contaminated(docs.limit(0), bench).count() == 0
