"""Terms that disclose an entity, and where they are treated."""

import math
import random
import re
from collections import defaultdict

import pytest

from airlens.llm import pii

WORDS = [f"{a}{b}{c}" for a in ("bor", "cal", "dun", "fel", "gar") for b in ("an", "es", "il", "ot") for c in ("da", "mek", "pros", "tul")]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def clean(spark, texts):
    return {r.doc_id: r.text for r in pii.sanitise(frame(spark, texts)).collect()}


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_terms_of_documents_with_the_entity_and_of_two_together(spark):
    rng = random.Random(1)
    held = [f"{prose(rng, 12)} Kim\n\n{prose(rng, 5)}\nwrite to\nq@mail.example.com\n{prose(rng, 12)}. Later on 李明 and Kim met" for _ in range(30)]
    texts = held + ["yesterday Kim was seen", "both 李明 and Kim stood"] + [f"{prose(rng, 20)} Later met write" for _ in range(600)]
    got = clean(spark, texts)
    for k, text in enumerate(held):
        assert got[k] == text.replace("q@mail.example.com", "[EMAIL]").replace("Kim", "[NAME]").replace("李明", "[WORD]")
    # One term alone tells no more than a common name; both together tell whom they stand with.
    assert got[30] == texts[30] and got[31] == "both [WORD] and [NAME] stood"
    assert all(got[k] == texts[k] for k in range(32, len(texts)))


def test_few_meetings_and_copies_disclose_nothing(spark):
    rng = random.Random(2)
    copy = "Zorbatron stands here, write to q@mail.example.com at noon"
    few = [f"{prose(rng, 9)} Quixby wrote from r@mail.example.com {prose(rng, 9)}" for _ in range(3)]
    texts = [copy] * 40 + few + ["Smith wrote\nfrom jane.smith@mail.example.com about smithing"] + [prose(rng, 30) for _ in range(400)]
    got = clean(spark, texts)
    assert {got[k] for k in range(40)} == {copy.replace("q@mail.example.com", "[EMAIL]")}
    assert [got[40 + k] for k in range(3)] == [t.replace("r@mail.example.com", "[EMAIL]") for t in few]
    assert got[43] == "[NAME] wrote\nfrom [EMAIL] about smithing"
    assert all(got[k] == texts[k] for k in range(44, len(texts)))


def plain_disclosing(texts):
    """(entity, term) -> share, by counting every pair of every document."""
    total, with_entity, with_term, both = len(texts), defaultdict(list), defaultdict(int), defaultdict(list)
    fits, rows = set(), []
    for text in texts:
        spans = pii.base_spans(text)
        contexts = {}
        for kind, a, b in spans:
            entity = pii._entity(kind, text[a:b])
            contexts[entity] = min(contexts.get(entity, 1 << 63), pii._context(text, a, b))
        words = [m.group() for m in re.finditer(r"[^\W\d_]+", text) if not any(a < m.end() and m.start() < b for _, a, b in spans)]
        terms = {w.lower() for w in words}
        for t in terms:
            with_term[t] += 1
        if spans:
            fits |= {w.lower() for w in words if pii._fits(w)}
        for entity, context in contexts.items():
            with_entity[entity].append(context)
        rows.append((contexts, terms))

    def share(given, n):
        own = math.log(n / total)
        return 0.0 if own >= 0 else 1 - math.log(min(given, 1.0)) / own

    able = {e for e, c in with_entity.items() if share(pii.LEVEL ** (1 / len(set(c))), len(c)) >= pii.DISCLOSURE}
    seen = defaultdict(int)
    for contexts, terms in rows:
        if able & contexts.keys():
            for t in terms:
                seen[t] += 1
    most = max((len(with_entity[e]) ** pii.DISCLOSURE * total ** (1 - pii.DISCLOSURE) for e in able), default=0)
    kept = {t for t, n in seen.items() if t in fits and 1 < n <= most}
    for contexts, terms in rows:
        for e in able & contexts.keys():
            for t in terms & kept:
                both[e, t].append(contexts[e])
    level = pii.LEVEL / max(len(both), 1)
    found = {}
    for (e, t), c in both.items():
        value = share(level ** (1 / len(set(c))) * len(c) / with_term[t], len(with_entity[e]))
        if value >= pii.DISCLOSURE:
            found[e, t] = value
    return found


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    names = ["Anders", "Brook", "Chandra", "Dov", "李明", "Eva"]
    texts = []
    for _ in range(900):
        text = prose(rng, rng.randrange(5, 30))
        if rng.random() < 0.3:
            k = rng.randrange(6)
            said = names[k] if rng.random() < 0.9 else rng.choice(names)
            text += f"\n{said} of {'Acme' if k < 2 else 'Blot'}: m{k}@mail.example.com {prose(rng, 6)}"
            if rng.random() < 0.2:
                text += " or 10.0.0.1"
        elif rng.random() < 0.05:
            text += f" {rng.choice(names)}"
        texts.append(text)
    docs = frame(spark, texts)
    keyed = pii._keyed(docs)
    got = {(r.entity, r.term): r.share for r in pii.disclosing(keyed, pii.scanned(keyed)).collect()}
    want = plain_disclosing(texts)
    assert got.keys() == want.keys() and len(want) > 3
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_given_table_keeps_clean_documents(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet")
    after = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    clean_ones = [r for r in docs.collect() if not pii.base_spans(r.text)]
    assert sum(after[r.doc_id] == r.text for r in clean_ones) >= 0.98 * len(clean_ones)
    assert not any(pii.base_spans(t) for t in after.values() if t)
