import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekiln.llm import stuffing as sf
from lorekiln.llm.automaton import repeat_lengths


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(2, 4))
def test_repeats_equal_brute_force(symbols, least):
    n = len(symbols)
    counts = Counter(tuple(symbols[i:j]) for i in range(n) for j in range(i + 1, n + 1))
    want = [max((k for k in range(1, i + 2) if counts[tuple(symbols[i + 1 - k : i + 1])] >= least), default=0) for i in range(n)]
    assert repeat_lengths(symbols, least) == want


PROSE = "The gateway keeps the order until the broker has signed it. If a replica is late, the team opens a ticket and waits. Nobody reads the old snapshot after that, because it was archived. "
R = random.Random(2)
NOUNS = ["gateway", "ledger", "broker", "replica", "parcel", "snapshot", "tenant", "voucher", "window", "cluster", "digest", "schema", "rollout", "ticket"]
SPAM = {
    "keywords": " ".join(R.choice(["cheap", "lamp", "buy", "best"]) for _ in range(200)),
    "commas": ", ".join(R.choice(["lamp cheap", "buy lamp", "best lamp", "lamp"]) for _ in range(80)),
    "shouting": " ".join(R.choice(["Lamp cheap lamp!", "Buy lamp best?", "Best lamp lamp buy."]) for _ in range(60)),
    "hashtags": " ".join(f"#{R.choice(NOUNS)}" for _ in range(60)),
    "pipes": " | ".join(R.choice(NOUNS) for _ in range(60)),
    "wikilinks": " ".join(f"[[{R.choice(NOUNS)}]]" for _ in range(60)),
    "links": "\n".join(f"- [{R.choice(NOUNS)}](https://{R.choice(NOUNS)}.test/{R.choice(NOUNS)})" for _ in range(40)),
    "html": "<ul>" + "".join(f'<li><a href="https://x.test/{R.choice(NOUNS)}">{R.choice(NOUNS)}</a></li>' for _ in range(60)) + "</ul>",
    "bare": "\n".join(f"https://{R.choice(NOUNS)}.test/{R.choice(NOUNS)}" for _ in range(40)),
    "with function words": "The lamp is the lamp of the lamp and the lamp for the lamp. " * 20,
    "below a little prose": PROSE + "\n\n" + ", ".join(R.choice(["lamp cheap", "buy lamp", "best lamp"]) for _ in range(120)),
}
NOTES = {
    "prose": PROSE * 3,
    "table": "| item | note |\n|---|---|\n" + "\n".join(f"| {n} | The {n} is kept until the team has signed it. |" for n in NOUNS),
    "list": "\n".join(f"- The {n} must be kept for {i} days after the review." for i, n in enumerate(NOUNS)),
    "links with sentences": "\n".join(f"- [{n}](https://{n}.test/a/b?id=1): The {n} must be kept after the review." for n in NOUNS),
    "links section": PROSE * 2 + "\n\n## Links\n" + "\n".join(f"- [[{n}]]" for n in NOUNS[:6]),
    "frontmatter": "---\ntags: [a, b, c, d, e, f, g]\n---\n" + PROSE,
    "upper case": (PROSE * 2).upper(),
    "wrapped": (PROSE * 2).replace(" the", "\nthe"),
    "quoted": "\n".join("> " + s for s in (PROSE * 2).split(". ")),
    "german": "Wer die Ablage ändert, passt bitte auch die Freigabe an. Mehr als zwei Einträge hält der Dienst nicht, der Rest geht in die alte Notiz. " * 2,
    "vietnamese": "Nếu thực thể đã duyệt trễ hơn 970 phút thì máy chủ gửi lược đồ. Chỉ nhóm này được ghi vào kho lưu trữ, mọi cổng khác đều cũ. " * 2,
    "same sentence again": "The broker must log its ticket before the broker starts. " * 12,
}


@pytest.mark.parametrize("name", sorted(SPAM))
def test_spam(name):
    total, stuffed, share = sf.measured(SPAM[name])
    assert total >= 20 and share > 0.5, (total, stuffed, share)


@pytest.mark.parametrize("name", sorted(NOTES))
def test_notes(name):
    assert sf.measured(NOTES[name])[2] <= 0.5


def test_rows(spark):
    rows = [(1, SPAM["commas"]), (1, SPAM["commas"]), (2, PROSE), (3, None), (4, ""), (5, "lamp lamp"), (6, "buy lamp " * 100_000)]
    frame = spark.createDataFrame(rows, "doc long, body string").withColumns({"id": F.lit("clash"), "text": F.lit(0), "share": F.lit(1)})
    assert sorted(r["id"] for r in sf.stuffed_pages(frame, "doc", "body").collect()) == ["1", "1", "6"]
    assert sf.stuffed_pages(frame.limit(0), "doc", "body").count() == 0


WHOLE = {
    "headings": ("\n\n".join(f"## {R.choice(['buy shoes', 'cheap shoes', 'shoes sale'])}" for _ in range(30)), True),
    "tags in frontmatter": ("---\ntitle: Page\ntags: [" + ", ".join(R.choice(NOUNS) for _ in range(40)) + "]\n---\nThe page is kept for the team.", True),
    "dashed tags": ("---\ntags:\n" + "\n".join(f"  - {R.choice(NOUNS)}" for _ in range(40)) + "\n---\n", True),
    "few keywords": ("buy lamp, " * 7 + "buy", True),
    "code with few links": ("```\n" + "for row in rows: total = total + row\n" * 20 + "```\n" + "\n".join(f"- [{n}](https://{n}.test/a)" for n in NOUNS[:12]), False),
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_all_words_of_the_page_count(spark, name):
    text, found = WHOLE[name]
    assert sf.stuffed_pages(spark.createDataFrame([(1, text)], "doc long, body string"), "doc", "body").count() == found


FOREIGN = {
    "finnish": "Yhdyskäytävä säilyttää tilauksen, kunnes välittäjä on allekirjoittanut sen. Jos kopio myöhästyy, ryhmä avaa tiketin ja odottaa vastausta. Kukaan ei lue vanhaa tilannekuvaa sen jälkeen, koska se on jo arkistoitu. ",
    "turkish": "Ağ geçidi, aracı imzalayana kadar siparişi saklar. Kopya gecikirse ekip bir kayıt açar ve yanıt bekler. Eski anlık görüntüyü bundan sonra kimse okumaz, çünkü arşivlenmiştir. ",
    "polish": "Brama przechowuje zamówienie, dopóki pośrednik go nie podpisze. Jeśli replika się spóźnia, zespół otwiera zgłoszenie i czeka na odpowiedź. Nikt nie czyta potem starej migawki, ponieważ została zarchiwizowana. ",
    "chinese": "网关会一直保留订单，直到经纪人签字为止。如果副本迟到，团队会开一张工单，然后等待答复。之后没有人再读旧快照，因为它已经归档，并且只在审计时打开。",
    "one shape": "The gateway must log its ticket before the gateway starts. The broker must log its parcel before the broker starts. The ledger must log its digest before the ledger starts. ",
}


@pytest.mark.parametrize("times", [1, 4])
@pytest.mark.parametrize("name", sorted(FOREIGN))
def test_prose_of_any_language_is_no_spam(name, times):
    assert sf.measured(FOREIGN[name] * times, 0.0)[2] <= 0.5


@pytest.mark.parametrize("name", sorted(SPAM))
def test_nothing_is_found_without_covered_characters(monkeypatch, name):
    monkeypatch.setattr(sf, "repeat_lengths", lambda symbols, least: [0] * len(symbols))
    assert sf.measured(SPAM[name])[2] == 0.0


def test_spam_of_another_language_is_found():
    words = ["lamppu", "halpa", "osta", "paras"]
    assert sf.measured(FOREIGN["finnish"] + "\n\n" + " ".join(R.choice(words) for _ in range(200)))[2] > 0.5
