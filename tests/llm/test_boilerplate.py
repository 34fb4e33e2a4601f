import random

from pyspark.sql import functions as F

from leafloom.llm import boilerplate as B


def tokens(content, site="mysite"):
    return [(no, t) for _, no, _, t, _, _ in B.page_tokens(content, site)]


def test_tokens_of_a_page():
    page = "\n".join([
        "Skip to the text", "![logo](https://mysite.example/l.svg)", "[Shop](/s) [Help](/h)", "Shop | Contact", "", "> **🍪 Mysite: We keep files (12)**", "Home > Garden > Chairs", "# A title of 2024", "",
        "## Read on:", "- [One of many long titles](/a/1)", "Two »", "- [An item of its own](https://mysite.example/p/1)", "1 2 3 … 9 Next »", "Mysite App: Something new for today. [→](/app)", "★ This and that → Mysite Plus", "| a | b |",
    ])
    assert tokens(page) == [
        (1, "skip to the text"), (2, "!logo"), (3, "shop"), (3, "help"), (4, "shop"), (4, "contact"), (6, "we keep files"), (7, "home > …"), (8, "a title of 0"),
        (10, "read on ↴"), (11, "[…](/…)"), (12, "… »"), (13, "[…](http…)"), (14, "0 0 0 …"), (15, "§ app: …"), (16, "… → § plus"), (17, "| a | b |"),
    ]


#: Furniture of two languages that the library says nothing about.
DUTCH = ["Naar de inhoud", "Winkel | Hulp | Mijn gegevens", "Wij en onze partners bewaren kleine bestanden. Weigeren / Toestaan.", "Alle rechten voorbehouden door de uitgever van deze bladzijden.", "Meld u aan voor de nieuwsbrief!"]
SWEDISH = ["Till innehållet", "* [Butik](/b)", "* [Hjälp](/h)", "Vi sparar små filer på din enhet. Godkänn alla eller avböj.", "Alla rättigheter förbehållna.", "Följ oss i andra kanaler"]


def site_pages(name, furniture, n, r, top, partly=0.0):
    out = []
    for i in range(n):
        body = [f"Title {r.choice('abcdefgh')}{r.choice('klmnop')} {i * 7919 % 1000}", *(" ".join(r.choice("lorem ipsum dolor sit amet vita nova terra mare caelum".split()) for _ in range(12)) + f" {name}{i}." for _ in range(4))]
        f = [x for x in furniture if r.random() >= partly]
        above = [x for x in f if x in furniture[:top]]
        lines = [*above, "", *body, "", *(x for x in f if x not in above)]
        want = {k for k, x in enumerate(lines, 1) if x in furniture}
        out.append((f"{name}{i}", f"https://www.{name}.example/{i}", "\n".join(lines), want))
    return out


def test_furniture_of_unknown_wording_is_found(spark):
    r = random.Random(4)
    pages = site_pages("nieuw", DUTCH, 14, r, 3) + site_pages("nytt", SWEDISH, 12, r, 4, 0.2) + site_pages("tiny", ["Lone menu", "Lone foot"], 1, r, 1)
    df = spark.createDataFrame([p[:3] for p in pages], "id string, source string, content string")
    got = {(x.id, x.line_no) for x in B.template_lines(df).collect()}
    want = {(i, k) for i, _, _, ks in pages if not i.startswith("tiny") for k in ks}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)
    assert not {k for k in got if k[0].startswith("tiny")}  # met once, on one site


def test_long_lines_and_sentences_can_be_template(spark):
    r = random.Random(9)
    notice = "This long notice says what is kept and why. " * 150
    assert len(notice) > 5000
    pages = site_pages("longer", ["Menu one", notice.strip(), "Foot line", "Last line"], 10, r, 2)
    got = {(x.id, x.line_no) for x in B.template_lines(spark.createDataFrame([p[:3] for p in pages], "id string, source string, content string")).collect()}
    assert got == {(i, k) for i, _, _, ks in pages for k in ks}


def test_nulls_copies_and_odd_tables(spark):
    r = random.Random(2)
    pages = [p[:3] for p in site_pages("crin", ["Menu", "Notice", "Foot", "Last"], 6, r, 2)]
    pages += [("n", None, None), (None, "x", "y"), ("e", "", ""), pages[0], ("copy", pages[1][1], pages[1][2])]
    df = spark.createDataFrame(pages, "id string, source string, content string").withColumn("line_no", F.lit("clash")).withColumn("site", F.lit(1)).withColumn("page", F.lit(1))
    got = [(x.id, x.line_no) for x in B.template_lines(df).collect()]
    assert len(got) == len(set(got)) == 7 * 4 and {i for i, _ in got} == {f"crin{i}" for i in range(6)} | {"copy"}
    body = {x.id: x.body for x in B.main_body(df).collect()}
    assert body["crin0"].startswith("\nTitle") and "Menu" not in body["crin0"] and body["n"] is None and body["e"] == ""
    assert B.template_lines(df.limit(0)).count() == 0


def test_very_long_text_and_odd_lines():
    page = "x" * 300_000 + "\n" + "(1)\n**\n>\n| a | b |\n· | ·\n[](\n★ → \n©\n"
    assert all(isinstance(n, int) for n, _ in tokens(page, ""))
    assert B.bare("> **🍪 Mysite: Hello there (12)**", "mysite") == "Hello there"
    assert B.site_of("text\n© 2024 Fjor. Site map", None) == "fjor" and B.site_of("", None) == ""
