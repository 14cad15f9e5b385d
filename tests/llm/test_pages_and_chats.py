"""Chat windows, main text and path templates."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import pytest

from shiftlens.llm import chat, html_text, path_templates

TEXTS = ["", None, "\\", "#", "##### a", "</turn>", "<\\/turn>", "### user ###\n", "a\n</turn>\n### system ###\nb", "\\\\#\\", " <", "日本 ñ\x00"]


def conversations():
    rows, r = [], random.Random(1)
    for conv in range(12):
        for turn in range(r.randint(1, 60)):
            role = "system" if turn == 0 and conv % 2 else r.choice(["user", "assistant", "to#ol ###\n", None])
            rows.append((conv, turn, role, r.choice(TEXTS) if r.random() < 0.5 else "x y" * r.randint(1, 900)))
    rows += [(None, None, None, None), (None, 1, "assistant", "z"), (50, None, "assistant", "first"), (50, 0, "assistant", "then"), (51, 0, "user", "same"), (51, 0, "user", "same")]
    rows.append((60, 0, "assistant", "w " * 40_000))
    return rows


@pytest.mark.parametrize("budget", [chat.Budget(), chat.Budget(tokens=200, history=30)])
def test_windows_give_every_turn_back(spark, budget):
    rows = conversations()
    table = spark.createDataFrame([(*r, 0, "w") for r in rows], "conv_id long, turn long, role string, text string, window int, place string").repartition(4)
    windows = chat.format_windows(table, budget)
    got = {r["conv_id"]: r for r in chat.conversation_digests(windows).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0))
        text = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns)
        loss = "".join(t or "" for _, _, r, t in turns if r == "assistant")
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    found = windows.collect()
    assert got.keys() == {r[0] for r in rows}
    for w in found:
        assert w["text"].count("</turn>\n") == w["n_turns"]
        marked = w["text"].split("</turn>\n")[:-1]
        sizes = [-(-(len(m) + len("</turn>\n")) // budget.chars_per_token) for m in marked]
        assert w["tokens"] == sum(sizes) and w["over_budget"] == (sum(sizes) > budget.tokens)
        # only a turn that does not fit beside the system turn passes the budget, and then nothing else stands in its window
        assert sum(sizes) <= budget.tokens or w["n_turns"] == 1 or w["n_turns"] == 2 and marked[0].startswith("### system ###\n")
    first = min((w for w in found if w["conv_id"] == 1), key=lambda w: w["window"])
    assert all(w["text"].startswith(first["text"].split("</turn>\n")[0]) for w in found if w["conv_id"] == 1)


def test_turns_that_fit_are_never_over_budget(spark):
    sizes = {1: [500, 500, 3000, 1100], 2: [1024] * 9, 3: [1, 1025, 1, 4096, 1, 1], 4: [3800, 200, 290, 5, 5, 5], 5: [40] * 300, 6: [40] * 100}
    rows = []
    for conv, tokens in sizes.items():
        for turn, n in enumerate(tokens):
            role = "system" if conv == 4 and turn == 0 else "assistant"
            rows.append((conv, turn, role, "x" * (4 * n - len(f"### {role} ###\n</turn>\n"))))
    windows = chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert not any(w["over_budget"] for w in windows) and max(w["tokens"] for w in windows) <= 4096
    many = [w for w in windows if w["conv_id"] == 5]
    assert len(many) == 5 and [w["n_turns"] for w in windows if w["conv_id"] == 6] == [100]
    assert sum(w["n_context"] > 0 for w in many) == len(many) - 1
    assert sum(w["n_turns"] - w["n_context"] for w in windows) == len(rows)


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.conversation_digests(chat.format_windows(none)).count() == 0


PAGES = {
    "<html><head><title>no</title></head><body><nav><a href=x>menu</a></nav><article><h1>T &amp; t</h1><p>a\n  b<br>c<p>d</article><footer>f</footer>": "T & t\na b c\nd",
    "<article><p>one</p><aside>no</aside><div class='ad-box'>buy</div><form>in</form><!-- x --><script>var a='<p>no</p>'</script><p>two<div class=comments>hi</div></article>": "one\ntwo",
    "<main><p>short</p></main><section id=comments><article><p>reader</p></article></section>": "short",
    "<div class=menu>Home</div><div><p>" + "main text " * 20 + "</p><p>tail</p></div><div><a href=1>link one</a> <a href=2>link two</a></div>": "main text " * 19 + "main text\ntail",
    "a &lt; b &#x41; &eacute;": "a < b A é",
    "": "", None: "", "<nav>only</nav>": "", "<p": "", "<!-- open": "", "<script>open": "", "</p></div>x": "x",
}


def test_main_text(spark):
    rows = [(i, None if i % 2 else "u", page, "t", 3) for i, page in enumerate([*PAGES, *PAGES])]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: PAGES[page] for i, _, page, _, _ in rows}
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_chrome_cuts_no_passage():
    long, advert = "<p>" + "word " * 60 + "</p>", "<div class=ad><p>Buy</p><p>this</p><p>now</p></div>"
    page = f"<body><p>A lead.</p>{advert}{long}{long}{advert}<p>The end, by Jane.</p></body>"
    want = ["A lead.", ("word " * 60).strip(), ("word " * 60).strip(), "The end, by Jane."]
    assert html_text.main_text(page).split("\n") == want
    outside = "<p>one</p><p>two</p><p>three</p>"
    assert html_text.main_text(f"{outside}<article>{long}</article>{outside}<article><p>A note.</p></article>{outside}").split("\n") == [want[1], "A note."]


PARAGRAPH = "One sentence of the text, and then another one that goes on for longer than a menu does."
WRAPPED = f"<h1>Title</h1><p>{PARAGRAPH}</p><p>{PARAGRAPH} Again.</p>"
WANTED = f"Title\n{PARAGRAPH}\n{PARAGRAPH} Again."


def test_names_are_votes():
    """No name takes away a part that holds the text of the page; compound names are no names of menus."""
    for open_, close in (
        ("<main class='has-sidebar'>", "</main>"), ("<div class='site right-sidebar'>", "</div>"), ("<article class='post comments-open'>", "</article>"),
        ("<form id=page>", "</form>"), ("<body class=menu>", "</body>"), ("<div id=sidebar><div class='post'>", "</div></div>"),
    ):
        notice, comments = "<div class=notice>We use cookies on all of this site.</div>", "<div class='comments-area'><p>Nice text, that I did read.</p></div>"
        assert html_text.main_text(f"<nav>Home</nav>{notice}{open_}{WRAPPED}{close}{comments}<footer>Imprint</footer>") == WANTED, open_
        assert html_text.main_text(f"<nav>Home</nav>{open_}{WRAPPED}{comments}{notice}{close}") == WANTED, open_
    inside = "<section id='share-prices'><p>Prices rose.</p></section><div class='social-history'><p>They had fallen.</p></div>"
    assert html_text.main_text(f"<article>{WRAPPED}{inside}</article>") == WANTED + "\nPrices rose.\nThey had fallen."
    long_comments = "<section class=comments>" + f"<p>{PARAGRAPH}</p>" * 6 + "</section>"
    assert html_text.main_text(f"<div>{WRAPPED}</div>{long_comments}") == WANTED
    advert = f"<div class=ad>{PARAGRAPH} {PARAGRAPH}</div>"
    assert html_text.main_text(f"{advert}<article><h1>Short</h1><p>{PARAGRAPH}</p></article>") == f"Short\n{PARAGRAPH}"
    assert html_text.main_text(f"<div class='site right-sidebar'>{advert}{WRAPPED}{long_comments}</div>") == WANTED
    teasers = "<article><p>Read this</p></article>" * 3
    assert html_text.main_text(f"<div>{WRAPPED}</div><div class=related>{teasers}</div>") == WANTED


def test_entries_without_marks():
    menu = "".join(f"<div>{x}</div>" for x in ("Home", "About us", "Products", "Contact"))
    legal = "".join(f"<p>{x}</p>" for x in ("Terms", "Privacy", "Imprint"))
    items = "<ul><li>flour<li>sugar<li>salt<li>butter</ul>"
    assert html_text.main_text(f"{menu}{WRAPPED}{legal}") == WANTED
    assert html_text.main_text(f"{menu}{WRAPPED}{items}<p>{PARAGRAPH}</p>{legal}") == f"{WANTED}\nflour\nsugar\nsalt\nbutter\n{PARAGRAPH}"
    assert html_text.main_text(f"<p>by Jane</p>{WRAPPED}<p>Jane</p>") == f"by Jane\n{WANTED}\nJane"
    links = "".join(f"<p><a href={i}>A link to another page of this site</a></p>" for i in range(4))
    assert html_text.main_text(f"{links}{WRAPPED}{links}") == WANTED


def test_passages_against_plain_windows():
    r = random.Random(3)
    for _ in range(300):
        weights = [r.choice([0, 0, 0, 5, 30, 200]) for _ in range(r.randint(0, 30))]
        sums = [sum(weights[i : i + html_text.LINES]) for i in range(len(weights))]
        want, i = [], 0
        while i < len(weights):
            j = i
            while j < len(weights) and sums[j]:
                j += 1
            if j > i and max(sums[i:j]) >= min(html_text.SURGE, html_text.SHARE * max(sums)):
                want.append((i, j))
            i = max(j, i + 1)
        assert html_text.passages(weights) == want


def test_given_pages_without_marks_give_the_same(sf):
    for row in sf("pages").select("html").collect():
        bare = row["html"].replace("<article", "<div").replace("</article", "</div")
        assert html_text.main_text(bare) == html_text.main_text(row["html"]) != ""


@pytest.mark.parametrize("piece", ["<div>", "<p>", "</b>", "<b>", "</p>", "<a b=\"", "<li>", "<td><table>", "<form><p>", "<h1></div>", "<a b='x\""])
def test_broken_pages_take_linear_time(piece):
    begin = time.process_time()
    html_text.main_text(piece * 100_000 + "x")
    assert time.process_time() - begin < 10


def test_long_page_and_no_pages(spark):
    assert html_text.main_text("<article>" + "<p>x</p>" * 50_000 + "</article>").count("\n") == 49_999
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_given_pages_give_their_articles(spark, sf):
    for row in html_text.extract(sf("pages")).join(sf("pages").select("page_id", "html"), "page_id").collect():
        article = row["html"].split("<article>")[1].split("</article>")[0]
        assert row["n_chars"] > 0 and row["text"].split("\n")[0].split(" ")[0] in article
        assert "track(" not in row["text"]


RULES = ([("org", "/"), ("com", "/fr/")], [("example.org", "/es/"), ("example.org", "/en/1"), ("com", "/de/")])


def test_rules_and_parts(spark):
    urls = {
        "http://A.Example.ORG/es/1?x#y": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "http://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://myexample.org/es/": ("myexample.org", "/es/", "org/", "allow"),
        "http://x.com/de/": ("x.com", "/de/", "com/de/", "block"),
        "http://x.com": ("x.com", "", None, "allow"),
        "http://x.org?a=/b": ("x.org", "", None, "allow"),
        "x.org/es/": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
    }
    rows = [(i, u, "h", "r") for i, u in enumerate([*urls, *urls, None])]
    got = path_templates.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string, rule string"), *RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == urls[rows[r["page_id"]][1]]
    assert path_templates.judge_urls(spark.createDataFrame([], "page_id long, url string"), *RULES).count() == 0


def test_templates_learn_from_labels(spark):
    r = random.Random(2)
    rows = []
    for i in range(400):
        rows.append(("a.net", f"/spam/{r.choice('abc')}{i}/", 1 if i % 4 else None))
        rows.append(("a.net", f"/news/{i}.html", 0 if i % 4 else None))
        rows.append(("a.net", f"/user/{''.join(r.choice('abcdefghij') for _ in range(7))}/home", None))
        rows.append(("a.net", f"/ok{i % 3}/x", [0, 0, 0][i % 3]))
    table = spark.createDataFrame(rows, "host string, path string, bad int")
    got = path_templates.template_verdicts(table).collect()
    by = {x["template"]: x for x in got}
    assert any(x["rejected"] for x in got if x["template"].startswith("spam/"))
    assert not any(x["rejected"] for x in got if not x["template"].startswith("spam/"))
    assert by["news/{n}.html"]["labelled"] == 300
    # four hundred names in one place of a path, and nothing known about them: one template
    assert len({x["template"] for x in got if x["shape"][0] == "user"}) == 1
    # against the plain share: every shape is in one template, and its share is that of the template's labels
    assert len({(x["host"], tuple(x["shape"])) for x in got}) == len(got)


def plain_templates(rows):
    """The tree written out in Python: {(host, shape): (template, labelled, share, rejected)}."""
    pt, shapes = path_templates, {}
    for host, path, bad in rows:
        found = shapes.setdefault((host, tuple(re.sub("[0-9]+", "{n}", path.removeprefix("/")).split("/"))), [0, 0, 0])
        found[0], found[1], found[2] = found[0] + 1, found[1] + (bad or 0), found[2] + (bad is not None)
    template = {k: k[1] for k in shapes}
    depth = max(len(k[1]) for k in shapes)

    def nodes(level):
        found = defaultdict(lambda: defaultdict(list))
        for k in shapes:
            if len(template[k]) > level:
                found[k[0], template[k][:level]][template[k][level]].append(k)
        return found.items()

    def rename(keys, level, name):
        for k in keys:
            template[k] = (*template[k][:level], name, *template[k][level + 1 :])

    for level in range(depth):
        for _, children in nodes(level):
            count = {s: sum(shapes[k][0] for k in keys) for s, keys in children.items()}
            rare = {s: n for s, n in count.items() if n * pt.COMMON < sum(count.values())}
            total, met = sum(rare.values()), sum(n * (n - 1) for n in rare.values())
            if rare and (met + 2 * pt.SPARE) * pt.COMMON <= total * (total - 1):
                for s in rare:
                    rename(children[s], level, "*")
    for level in range(depth):
        for _, children in nodes(level):
            side, rests = {}, {s: Counter() for s in children}
            for s, keys in children.items():
                bad, labelled = sum(shapes[k][1] for k in keys), sum(shapes[k][2] for k in keys)
                if labelled:
                    side[s] = "*-" if 2 * bad > labelled else "*+"
                for k in keys:
                    rests[s][template[k][level + 1 :]] += shapes[k][0]
            pool = {x: sum((rests[s] for s in side if side[s] == x), Counter()) for x in ("*-", "*+")}
            likes = {}
            for s in children.keys() - side.keys():
                score = Counter()
                for rest, n in rests[s].items():
                    share = {x: pool[x][rest] / pool[x].total() if pool[x] else 0 for x in pool}
                    for x in pool:
                        score[x] += n / rests[s].total() * share[x] / sum(share.values()) if sum(share.values()) else 0
                likes |= {s: x for x in ("*+", "*-") if score[x] >= pt.LIKE}
            cells = defaultdict(dict)
            for s, x in (side | likes).items():
                for k in children[s]:
                    cells[x, template[k][level + 1 :]].setdefault(s, []).append(k)
            for (x, _), found in cells.items():
                if len(found) > 1:
                    rename([k for keys in found.values() for k in keys], level, x)
    labels = [(k[0], template[k], *shapes[k][1:]) for k in shapes]

    def total(keep):
        return sum(x[2] for x in labels if keep(x)), sum(x[3] for x in labels if keep(x))

    def smoothed(counts, share):
        return (counts[0] + pt.WEIGHT * share) / (counts[1] + pt.WEIGHT)

    bad, labelled = total(lambda x: True)
    out = {}
    for k, t in template.items():
        own = total(lambda x: x[:2] == (k[0], t))
        share = smoothed(total(lambda x: x[0] == k[0] and x[1][:-1] != t[:-1]), bad / labelled if labelled else 0)
        share = smoothed(total(lambda x: x[0] == k[0] and x[1][:-1] == t[:-1] and x[1] != t), share)
        share = smoothed(own, share)
        out[k] = "/".join(t), own[1], pytest.approx(share), own[1] > 0 and share >= pt.REJECT
    return out


def test_tree_against_plain_python(spark):
    r, rows = random.Random(4), []
    for _ in range(1500):
        host = r.choice(["a.net", "a.net", "b.com", ""])
        first = r.choice(["de", "en", "x1", "shop", "".join(r.choice("abcdefgh") for _ in range(5))])
        rest = r.choice([["{}"], ["p", "{}"], ["".join(r.choice("ijkl") for _ in range(4)), "z"], []])
        bad = {"de": r.choice([1, 1, 1, 0]), "en": r.choice([0, 0, None]), "shop": r.choice([1, None])}.get(first)
        rows.append((host, "/" + "/".join([first, *rest]).format(r.randint(0, 9999)), bad if host != "b.com" or first == "de" else None))
    rows += [("deep.org", "/" + "/".join(["d"] * 3000), 1), ("deep.org", "", None), ("deep.org", "//", 0)]
    got = path_templates.template_verdicts(spark.createDataFrame(rows, "host string, path string, bad int")).collect()
    want = plain_templates(rows)
    assert {(x["host"], tuple(x["shape"])): (x["template"], x["labelled"], x["bad_share"], x["rejected"]) for x in got} == want
    assert len(got) == len(want) and len({x["rejected"] for x in got}) == 2


def test_branches_without_labels_follow_those_they_are_like(spark):
    rows = []
    for i in range(30):
        rows += [("a.net", f"/pills/{i}/buy/now.html", 1), ("a.net", f"/casino/{i}/buy/now.html", None)]
        rows += [("a.net", f"/news/2024/{i}/story", 0), ("a.net", f"/sport/2024/{i}/story", None), ("a.net", f"/wiki/{i}", None)]
        rows += [("b.net", f"/casino/{i}/buy/now.html", None)]
    got = path_templates.template_verdicts(spark.createDataFrame(rows, "host string, path string, bad int")).collect()
    assert {(x["host"], x["shape"][0]) for x in got if x["rejected"]} == {("a.net", "pills"), ("a.net", "casino")}


def test_segments_are_judged_alike_at_every_size():
    """A rare segment among few stays a name, names of users are variable, however many urls there are."""
    r = random.Random(5)
    for size in (400, 4000, 40_000):
        rows = [("a.net", f"/{r.choice(['news', 'shop'])}/{''.join(r.choice('abcdef') for _ in range(4))}", None) for _ in range(size)]
        assert {x[0] for x in plain_templates(rows).values()} == {"news/*", "shop/*"}
