import hashlib
import math
import random
import re
from collections import Counter

from siftwork.llm import pii

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": all(int(p) <= 255 for p in value.split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def brute(text):
    spans = sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if valid(kind, m.group()))
    shown = ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in spans)
    return [sum(1 for s in spans if s[1] == k) for k in range(4)], hashlib.sha256(shown.encode()).hexdigest()


def test_base_spans_against_python(spark, odd_rows):
    rng = random.Random(11)
    pieces = ["a.b+c@x-y.example.com", "%@a.b", "x@y", "1.2.3.4", "999.1.1.1", "010.002.0003.255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111", "+1 (017) 555-7713", "+31 6 1234", "+", "@", ".", " ", "-", "é", "12", "0000000000000", "\n", "a", "..@.", "a@b.c%d@e.f"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(300)] + [t for _, t in odd_rows] + ["9" * 20000, "a" * 20000 + "@", "1." * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_private(docs).collect():
        counts, digest = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts, texts[r.doc_id]
        assert r.base_sha256 == digest


def _corpus():
    """A code name that stands near one address in many surroundings, and words that stand near all addresses."""
    rows = []
    for i in range(6):
        rows.append(f"note{i} green{i} said{i} Zorblatt wrote{i} from big.boss@corp.example and left{i} the way")
    for i in range(40):
        rows.append(f"here word{i} the usual person wrote from user{i}@mail.example the usual way{i}")
    rows += [f"plain text number {i} and the usual words from here" for i in range(40)] + ["Zorblatt alone in a text"]
    return rows


def test_disclosing_terms(spark):
    rows = _corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(rows)], "doc_id long, text string, spans string, n_chars long")
    found = {r.doc_id: r for r in pii.find_private(docs, bits=3.0).collect()}
    assert all("term:" in found[i].spans for i in range(6))
    assert "term:" in found[len(rows) - 1].spans
    assert not any("term:" in found[i].spans for i in range(6, 86))
    start, end = map(int, re.search(r"term:(\d+):(\d+)", found[0].spans).groups())
    assert rows[0][start:end] == "Zorblatt"
    clean = {r.doc_id: r for r in pii.sanitise(docs, bits=3.0).collect()}
    assert clean[0].text == rows[0].replace("Zorblatt", "[TERM]").replace("big.boss@corp.example", "[EMAIL]")
    assert clean[50].text == rows[50] and clean[50].spans == "x"
    assert clean[0].n_chars == len(clean[0].text)


def test_copies_disclose_nothing(spark):
    text = "only here Quuxly wrote from one.person@mail.example about things"
    docs = spark.createDataFrame([(i, text) for i in range(20)] + [(20 + i, text + f" more{i}") for i in range(20)], "doc_id long, text string")
    assert all("term" not in r.spans for r in pii.find_private(docs).collect())


def test_edges(odd_docs, odd_rows, no_docs):
    assert pii.find_private(no_docs).count() == 0
    found = pii.find_private(odd_docs).collect()
    assert len(found) == len(odd_rows)
    assert all(r.spans == "" for r in found if r.doc_id in (7, 8))
    out = pii.sanitise(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == len(odd_rows)


def test_shared_passages_count_every_text(spark):
    """A name beside an address in few surroundings, each in many texts, and far from it in others, is certain."""
    rows = [f"Quuxly {('sent', 'gave', 'wrote')[i % 3]} to big.boss@corp.example" + f" and then number{i} word{i}" * 3 for i in range(30)]
    rows += [f"Quuxly {'stood ' * 30} far{i} from big.boss@corp.example" for i in range(6)]
    rows += [f"other text number{i} of the many{i}" for i in range(900)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.find_private(docs).collect()}
    assert all("term:0:6" in found[i].split(",") for i in range(36))
    assert not any("term" in found[i] for i in range(36, len(rows)))


def test_terms_near_an_entity(spark):
    """With a width, the last term of a text counts; half a word at the window's edge and words beyond do not."""
    rows = [f"mail{i} me{i} at big.boss@corp.example thing{i} Quuxly" for i in range(4)]
    pad = " " * 75
    rows += [f"one{i} two.boss@corp.example{pad}Frobnicate{i}" for i in range(4)] + ["Frobn here", "and here"]
    rows += [f"x{i} y{i} z{i} three.boss@corp.example{pad * 2}w{i} Farword v{i}" for i in range(4)]
    rows += [f"other text number{i} of the many{i}" for i in range(900)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.find_private(docs, near=80).collect()}
    assert all(f"term:{rows[i].index('Quuxly')}:{len(rows[i])}" in found[i] for i in range(4))
    assert not any("term" in found[i] for i in range(4, len(rows)))
    whole = {r.doc_id: r.spans for r in pii.find_private(docs).collect()}
    assert all(f"term:{rows[i].index('Farword')}:{rows[i].index('Farword') + 7}" in whole[i] for i in range(10, 14))


def brute_terms(rows, support=3, certainty=0.5, bits=4.0):
    """The statistic by its definition: every entity with every term, each time over all distinct texts."""
    texts = sorted({t for t in rows if t})
    terms = [re.findall(r"\w+", t) for t in texts]
    entities = [{(k, m.group().lower()) for k, (kind, p) in enumerate(PATTERNS) for m in re.finditer(p, t) if valid(kind, m.group())} for t in texts]
    out = set()
    for e in set().union(*entities):
        own = {i for i, es in enumerate(entities) if e in es}
        for term in set().union(*(terms[i] for i in own)):
            holding = {i for i, ts in enumerate(terms) if term in ts}
            both = own & holding
            p = len(both) / len(holding)
            if len(own) < support or len(both) < support or p < certainty or math.log2(p * len(texts) / len(own)) < bits:
                continue
            places = Counter()
            for i in both:
                ts = [None, *terms[i], None]
                places.update({(ts[k - 1], ts[k + 1]) for k in range(1, len(ts) - 1) if ts[k] == term})
            if sum(places.values()) ** 2 / sum(n * n for n in places.values()) >= support - 1e-9:
                out.add(term)
    return out


def test_statistic_against_brute_force(spark):
    """Random texts with planted names, copies, near copies, several entities a text, and terms of all lengths."""
    rng = random.Random(31)
    plain = [f"w{rng.randrange(150)}" for _ in range(300)] + ["é", "x" * 90]
    rows = []
    for k in range(14):
        name, mail = ["A", "Zorro", "N" * 80][k % 3] + str(k), f"m{k}@corp.example"
        for _ in range(rng.randrange(2, 8)):
            words = rng.sample(plain, rng.randrange(3, 20)) + [name] * rng.randrange(0, 3) + [mail] * rng.randrange(0, 2) + rng.sample(["10.0.0.7", "m3@corp.example"], rng.randrange(0, 2))
            rng.shuffle(words)
            rows.append(" ".join(words))
    passage = "only Copyname stands here with copy@corp.example and Sharedword beside it"
    rows += [passage] * 5 + [passage + f" tail{i}" for i in range(30)] + [passage.replace("stands", f"edit{i}") for i in range(4)]
    rows += [" ".join(rng.sample(plain, 9)) for _ in range(500)] + [None, ""]
    rng.shuffle(rows)
    expected = brute_terms(rows)
    assert len(expected) > 3 and "Copyname" not in expected and "Sharedword" not in expected
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {rows[r.doc_id][int(a) : int(b)] for r in pii.find_private(docs).collect() for a, b in re.findall(r"term:(\d+):(\d+)", r.spans)}
    # Terms that stand only inside addresses are covered by those already.
    def outside(term):
        for row in filter(None, rows):
            taken = [m.span() for kind, p in PATTERNS for m in re.finditer(p, row) if valid(kind, m.group())]
            if any(all(m.end() <= a or b <= m.start() for a, b in taken) for m in re.finditer(rf"(?<!\w){term}(?!\w)", row)):
                return True
        return False

    assert found == {t for t in expected if outside(t)}


def test_recall_and_precision_of_terms(spark):
    """Forty code names, each in nine texts with its own address among 2400 texts: how many are found, and what else."""
    rng = random.Random(23)
    names = [f"Codename{a}{b}" for a in "abcdefgh" for b in "vwxyz"]
    filler = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    rows = []
    for k, name in enumerate(names):
        rows += [f"{filler(12)} {name} {filler(2)} mail{k}@secret.example {filler(9)}" for _ in range(8)] + [f"{filler(20)} {name} {filler(5)}"]
    rows += [f"{filler(10)} user{rng.randrange(900)}@mail.example {filler(10)}" for _ in range(1000)] + [filler(25) for _ in range(1040)]
    rng.shuffle(rows)
    found = {r.doc_id: r.spans for r in pii.find_private(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    hits = Counter(rows[i][int(a) : int(b)] for i, spans in found.items() for a, b in re.findall(r"term:(\d+):(\d+)", spans))
    assert sum(hits[n] == 9 for n in names) >= 0.95 * len(names)
    assert sum(n for t, n in hits.items() if t in names) >= 0.95 * sum(hits.values())
