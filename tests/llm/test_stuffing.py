import random

from tidemark.llm.stuffing import blocks, is_sentence, stuffed_pages

PROSE = (
    "The committee kept the earlier figure because the receipt was missing. Nobody on the panel went below the base rate in spring. "
    "When the funding spread fell in earlier cycles, the long bond needed about two sessions to settle. "
    "What matters for the resolution is the value in the mirror feed, not the headline that was quoted before the open. "
)
KOREAN = "검토자는 변화가 일시적이라고 보았고 반대 의견도 함께 남겼다. 공식 일정표는 늦게 수집되어 이번 계산에서 제외했다. "


def found(spark, texts):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, blocks string")
    return sorted(r["doc_id"] for r in stuffed_pages(df).collect())


def test_stuffed_pages(spark):
    rng = random.Random(1)
    links = "\n".join(f"https://www.site{rng.randrange(99)}.example/tag/word-{rng.randrange(999)}" for _ in range(20))
    tickers = " ".join("$" + "".join(rng.choice("BCDFGH") for _ in range(4)) + rng.choice(["", " buy", " 🚀"]) for _ in range(60))
    texts = [
        "cheap gold / best gold / gold price today / " * 30, links, tickers, PROSE[:71] + "\n" + links, " ".join(f"#tag{k % 7}_word" for k in range(60)),
        "buy gold price. get gold price here. gold price and gold price for you. " * 30, "무료 리딩, 단타 강의, 주식 추천, " * 20, "\n".join(f"SKU {rng.randrange(99999)} | signal kit | ${rng.randrange(300)}" for _ in range(30)),
    ]
    assert found(spark, texts) == list(range(len(texts)))


def test_no_cases(spark):
    links = "\n".join(f"[{k}] credit, https://site.example/{k}" for k in range(4))
    texts = [
        None, "", "  \n ", "ok", "보류", "No change.", PROSE * 3, KOREAN * 5, PROSE * 2 + "\nReferences\n" + links, PROSE + "\n#gold #bond #rates",
        "\n".join(f"2024-01-{k:02d}T10:00:00Z INFO ingest rows={k} status=ok" for k in range(10, 30)), "\n".join(f"| 2024-02-{k:02d} | payrolls | {k}.1 | 2.0 |" for k in range(10, 29)),
        "\n".join('{"run":"ts-%d","gate":0.5}' % k for k in range(40)), "---\nphase: P2\nprobability: 27\n---\n" + KOREAN,
    ]
    assert found(spark, texts) == []


def test_the_form_of_data_does_not_hide_links_tags_and_keywords(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abdegiklmnorstu") for _ in range(rng.randrange(4, 9)))
    texts = [
        "\n".join(f"https://www.site{rng.randrange(99)}.example/2024-05-{rng.randrange(10, 30)}/{word()}-{word()}" for _ in range(20)),
        "\n".join(f"2024-05-{rng.randrange(10, 30)} https://www.site{rng.randrange(99)}.example/{word()}/{word()}-{word()}" for _ in range(20)),
        "cheap gold / best gold / gold price today / " * 15 + "updated 2024-05-01 " + "cheap gold / best gold / gold price today / " * 15,
        "\n".join(f"tags: {word()}, {word()}, {word()}" for _ in range(20)), "\n".join(f"| {word()} | {word()} | {word()} |" for _ in range(20)),
        "\n".join(f"keywords: {rng.choice(['cheap', 'best'])} gold {rng.choice(['price', 'coin', 'bar'])}" for _ in range(30)), "\n".join(f"# {rng.choice(['cheap', 'best'])} gold {rng.choice(['price', 'coin', 'bar'])} today" for _ in range(30)),
        "tags: " + ", ".join(word() for _ in range(60)),
    ]
    assert found(spark, texts) == list(range(len(texts)))
    records = [
        "\n".join(f"2024-05-{k} 10:0{k % 10}:00 GET https://site.example/{k} 200 in {k * 7} ms from worker {k % 3}" for k in range(10, 30)),
        "| country | status | owner |\n|---|---|---|\n" + "\n".join(f"| {word()} | open | {word()} |" for _ in range(20)),
        "\n".join(f"2024-05-{k} payrolls release, first print" for k in range(10, 30)), "\n".join(f"status: open\nowner: {word()}\nreceipts: rcp-{k}1, rcp-{k}2, rcp-{k}3" for k in range(20)),
        "\n".join('{"url": "https://site.example/%d", "status": 200, "bytes": %d}' % (k, k * 977) for k in range(30)), "2024-05-01 " + PROSE * 2,
    ]
    assert found(spark, records) == []


def test_lines_of_keywords_and_sentences_in_turn(spark):
    rng = random.Random(4)
    some = ["cheap", "best", "gold", "price", "coin", "bar", "today", "online", "buy", "sell"]
    keywords = lambda n: " ".join(rng.choice(some) for _ in range(n))
    variant = lambda: f"{rng.choice(['cheap', 'best', 'buy', 'sell'])} gold {rng.choice(['price', 'coin', 'bar', 'ring', 'watch'])} {rng.choice(['today', 'online', 'here', 'now'])}."
    short = ["The shop is open for you.", "It is all that we have.", "This is the one to get."]
    texts = [
        ". ".join([keywords(100), "We have been here for a long time and so will you be", keywords(100), short[0][:-1], keywords(20)]),
        " ".join(f"{keywords(40)}. {short[k % 3]}" for k in range(6)),
        " ".join(" ".join(variant() for _ in range(4)) + " " + short[k % 3] for k in range(8)),
    ]
    assert found(spark, texts) == list(range(len(texts)))
    notes = " ".join(f"{a} {b}." for a, b in zip(PROSE.split(". "), ["No change", "Agreed", "Base rate 27", "Late receipt"], strict=False))
    assert found(spark, [notes * 2, PROSE + " ".join(f"{PROSE[:71]} {keywords(8)}." for _ in range(4))]) == []


# prose of other scripts and languages, written for this test
OTHER = [
    "Совет директоров банка в пятницу сохранил ставку на прежнем уровне, отметив, что давление цен постепенно снижается. Аналитики ожидали такого решения, однако тон заявления оказался жестче прогнозов. Рубль отреагировал на новость умеренным укреплением, а рынок облигаций почти не изменился. Следующее заседание назначено на конец октября.",
    "中央银行周五宣布下调存款准备金率，以支持实体经济发展。分析人士认为，此举将释放大量的长期流动性。今年以来，房地产市场持续低迷，居民消费信心不足。官员表示，货币政策将保持稳健，并更加注重结构性工具的运用。股市在消息公布后小幅上涨，但成交量依然有限。",
    "Die Regierung hat am Mittwoch ein umfangreiches Paket zur Entlastung der Haushalte beschlossen. Nach Angaben des Ministers sollen vor allem Familien mit kleinen Einkommen davon profitieren. Die Opposition kritisierte, dass die Finanzierung noch nicht geklärt sei. An den Börsen blieb die Reaktion verhalten, der Leitindex schloss nahezu unverändert.",
    "El Gobierno aprobó este martes un nuevo plan de inversiones para modernizar la red ferroviaria del país. La ministra explicó que las obras comenzarán antes del verano y que se prolongarán durante tres años. Los sindicatos recibieron la noticia con cautela, porque todavía no se conocen los plazos. La oposición pidió más detalles sobre el origen de los fondos.",
    "日本の中央銀行は金曜日に会合を開き、政策金利を据え置くことを決めた。総裁は会見で、物価の見通しについて慎重に見極める必要があると述べた。市場では年内の利上げを予想する声が多いが、海外経済の減速を懸念する意見もある。円相場は発表の直後に小幅に下落した。",
    "أعلن البنك المركزي يوم الخميس تثبيت أسعار الفائدة للمرة الثالثة على التوالي، مشيرا إلى تراجع الضغوط. وقال محللون إن القرار جاء متوافقا مع توقعات السوق. وأضاف المحافظ أن البنك سيواصل مراقبة البيانات الاقتصادية قبل اتخاذ أي خطوة جديدة. وارتفعت الأسهم قليلا بعد الإعلان.",
    "भारतीय बैंक ने शुक्रवार को दर में कोई बदलाव नहीं किया। गवर्नर ने कहा कि महंगाई पर नज़र रखी जा रही है और आगे के फैसले आंकड़ों पर निर्भर होंगे। विश्लेषकों को इसी निर्णय की उम्मीद थी। बाज़ार में हल्की तेजी देखी गई।",
    "ธนาคารกลางประกาศคงอัตราดอกเบี้ยในการประชุมเมื่อวันพุธที่ผ่านมา โดยระบุว่าเศรษฐกิจยังคงฟื้นตัวอย่างค่อยเป็นค่อยไป นักวิเคราะห์ส่วนใหญ่คาดการณ์ไว้แล้วว่าจะไม่มีการเปลี่ยนแปลง ค่าเงินอ่อนค่าลงเล็กน้อยหลังการประกาศ และตลาดหุ้นปิดตลาดในแดนบวก",
]


def test_prose_of_any_script_is_no_case(spark):
    verse = "The rain had left the road a silver thread\nAnd no one walked along it but the wind\nThe mill was shut, the miller long since dead\nHis daughter sold the wheel and never grinned"
    headlines = "Bank keeps rates where they are after a long debate\nOil slips as stocks build more than expected\nChip maker raises outlook for the second half\nUnion votes to end the strike at the port"
    spoken = "“Where were you?” she asked. “Out.” “Out where?” He shrugged. The rain had stopped an hour ago. He had walked along the river, past the mill, past the church. “I went to see him,” he said. She put the cup down. “And?” “He is not coming back.”"
    assert found(spark, OTHER + [verse, headlines, spoken]) == []


def test_keywords_of_any_script_and_form_are_cases(spark):
    rng = random.Random(5)
    some = lambda words, n, by=" ": by.join(rng.choice(words.split()) for _ in range(n))
    shoes = "cheap shoes buy best online running"
    texts = [
        some("купить дешево обувь недорого москва цена онлайн кроссовки", 150), ", ".join(some("купить дешево недорого", 1) + " " + some("обувь кроссовки ботинки туфли сапоги куртки", 1) for _ in range(60)),
        "，".join(some("便宜 优质 正品 批发", 1) + some("鞋子 运动鞋 手机 手表 衣服", 1) for _ in range(80)), some("格安スニーカー 激安腕時計 人気バッグ 通販財布", 80), some("günstig kaufen Schuhe online billig Angebot bestellen", 120) + ".",
        "\n".join(f"keywords: {some(shoes, 7)}" for _ in range(40)), "\n".join(f"# {some(shoes, 5)}" for _ in range(40)), "\n".join(f"| cheap shoes | {some('buy best new', 1)} shoes |" for _ in range(40)),
        "\n".join(f"2024-05-{rng.randrange(10, 30)} {some(shoes, 7)}" for _ in range(40)), "Buy cheap shoes online at the best shoe store because our shoes are cheap and good. " * 40,
    ]
    assert found(spark, texts) == list(range(len(texts)))


def test_expected_ratios_by_script_and_language(spark):
    from tidemark.llm.stuffing import SCRIPTS, expected, measured

    df = spark.createDataFrame([(k, t, c) for k, (t, c) in enumerate([(PROSE * 3, "en-US"), (PROSE * 3, "EN"), (PROSE * 3, "de"), (PROSE * 3, None), (OTHER[0], "ru"), (None, "en")])], "doc_id long, text string, lang string")
    means = expected(measured(df, lang="lang"), least=2)
    assert {(s, c) for s, c, _ in means if c} == {(SCRIPTS.index("latin"), "en")}
    assert means[0, "en", 9] < means[0, "", 9] < means[SCRIPTS.index("kana"), "", 9]
    assert sorted(r["doc_id"] for r in stuffed_pages(df.unionByName(df.selectExpr("doc_id + 10 AS doc_id", "'gold price, ' || repeat('cheap gold, ', 40) AS text", "lang")), lang="lang").collect()) == list(range(10, 16))


def test_very_long_repeated_and_null_ids(spark):
    long_prose = "".join(f"{PROSE}Round {k} of the review was {k * 7} days late, and so it was left out. " for k in range(300))
    df = spark.createDataFrame([(None, "gold price, " * 20000), (1, "gold price, " * 50), (1, "gold price, " * 50), (2, long_prose)], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in stuffed_pages(df).collect()) == ["1", "1", "None"]
    assert stuffed_pages(df.limit(0)).collect() == []


def test_sentences_and_blocks():
    assert is_sentence("The receipt shows status 200 and 59 bytes.") and is_sentence("정정은 기존 기록을 고치지 않고 덧붙인다.")
    assert not is_sentence("near me.") and not is_sentence("total margin lecture best now.") and not is_sentence("No stop at the end of it")
    text = "x " * 5000
    assert "".join(b for _, b in blocks(text)).replace("\n", "").replace(" ", "") == "x" * 5000
