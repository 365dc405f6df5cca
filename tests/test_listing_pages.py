"""Literal pages: the properties read in one go are those that each field's own rule finds."""

from pyspark.sql import functions as F

from lotlens.operators import state
from lotlens.plans import services
from lotlens.sources import listing_pages, pages


def prop(label, value, more=""):
    return f'<span class="product-properties__i-name">{label}</span><span class="{more}product-properties__i-value">{value}</span>\n'


PAGES = {
    1: '<link rel="canonical" href="https://x.example/autos/1234567-bmw-530"><div class="product-price__i product-price__i--bold"> 43 500 AZN </div>'
    + prop("Şəhər", "Bakı") + prop("Marka", '<a href="/m">BMW</a>') + prop("Model", '<a href="/m"> 5  er </a>') + prop("Buraxılış ili", '<a href="#">2019</a>')
    + prop("Ban növü", "Sedan") + prop("Mühərrik", "2.0 L / 249 a.g. / Benzin") + prop("Yürüş", "120 000 km") + prop("Sürətlər qutusu", "Avtomat")
    + prop("Ötürücü", "Arxa ötürücü") + '<div class="product-shop__owner-featured"> Salon </div>'
    '<div class="x product-description__content y"><p>Vurulmayıb, rənglənməyib.</p>\n Ideal vəziyyətdə.</div>',
    2: prop("Марка", "Мерседес", "big ") + prop("Модель", "e klasse") + prop("Пробег", "98000") + prop("Двигатель", '<a href="#">1.8</a>') + prop("Состояние", "Битый"),
    3: prop("Marka", "") + prop("Marka", "KIA") + prop("Модель", "Rio") + prop("Model", "Ceed") + '<span class="product-properties__i-name">Yürüş</span><span class="other">7</span>',
    4: prop("Nömrə", "Marka") + '<span class="product-properties__i-value">Lada</span>' + prop("Şəhər", "Gəncə &amp; co") + "<b>Model</b>",
    5: "", 6: None, 7: "no markup at all > Marka </span>",
}


def landed(spark):
    return spark.createDataFrame([(k, f"https://x.example/autos/{k}0000", v) for k, v in PAGES.items()], "page_id int, url string, html string")


def test_one_go_finds_what_each_rule_finds(spark):
    rows = landed(spark)
    own = [pages.extract(F.col("html"), p).alias(n) for n, p in listing_pages.RULES.items()]
    want = {r.page_id: {n: r[n] for n in listing_pages.RULES if r[n] is not None} for r in rows.select("page_id", *own).collect()}
    got = {r.page_id: dict(r.raw or {}) for r in listing_pages.with_payload(rows).collect()}
    assert got == want
    assert got[1]["model"] == "5 er" and got[1]["fuel"] == "Benzin" and got[3]["make"] == "KIA" and got[3]["model"] == "Rio"
    assert len(got[1]) == 14 and not got[5] and not got[6]


def test_a_class_that_swallows_a_break_and_repeated_marks(spark):
    bold = '<div class="product-price__i--bold" data-x>'
    odd = '<b>Model</span><span class="product-properties__i-value</span><span class="> Rio </span>' + prop("Marka", "KIA") + bold + "1 AZN<"
    rows = [
        odd, "product-price__i--bold and <p class=\"x\">" + bold + " 5 USD <", prop("Mühərrik", "none") + prop("Двигатель", "2.0 / Dizel") + prop("Marka", "  "),
        'rel="canonical" x <link rel="canonical" href="/autos/12"> product-description__content</div><i class="y product-description__content">a <b>c</b></div>',
        "Marka</span>" + '<span class="product-properties__i-value">Lada</span>',
    ]
    landed_ = spark.createDataFrame(list(enumerate(rows)), "page_id int, html string")
    own = [pages.extract(F.col("html"), p).alias(n) for n, p in listing_pages.RULES.items()]
    want = {r.page_id: {n: r[n] for n in listing_pages.RULES if r[n] is not None} for r in landed_.select("page_id", *own).collect()}
    assert {r.page_id: dict(r.raw or {}) for r in listing_pages.with_payload(landed_).collect()} == want
    assert want[0]["model"] == "Rio" and want[1]["price"] == "5 USD" and want[2]["fuel"] == "Dizel" and want[3]["description"] == "a c" and not want[4]


def test_the_health_of_a_run_reads_its_pages_once(spark):
    rows = spark.createDataFrame([(1, "a", ["X"]), (2, None, [])], "price int, make string, errors array<string>")
    failures = F.avg(F.when(F.size("errors") > 0, 1.0).otherwise(0.0))
    rates = state.extraction_rates(rows, ["price", "make"], also={"failures": failures})
    assert {(r.field, r.rate, r.pages, r.failures) for r in rates.collect()} == {("price", 1.0, 2, 0.5), ("make", 0.5, 2, 0.5)}
    told = services.run_health(spark, "/root/testdata/sf0.001")
    assert "product-price" not in told._jdf.queryExecution().optimizedPlan().toString()  # the pages were read before, once


def test_literal_pages_become_listings(spark):
    got = {r.page_id: r for r in listing_pages.parse(landed(spark)).collect()}
    one = got[1]
    assert (one.listing_id, one.price, one.currency, one.mileage_km, one.make, one.model, one.model_year) == ("1234567", 43500.0, "AZN", 120000, "BMW", "5 SERIES", 2019)
    assert (one.fuel, one.transmission, one.drivetrain, one.body, one.displacement_l, one.seller_type) == ("PETROL", "AUTOMATIC", "RWD", "SEDAN", 2.0, "DEALER")
    assert (one.damage, one.repaint, one.errors, one.unmapped) == (False, False, [], []) and one.missing == ["condition"]
    assert (got[2].make, got[2].model, got[2].mileage_km, got[2].damage, got[2].errors) == ("MERCEDES-BENZ", "E-CLASS", 98000, True, ["NO_PRICE"])
    assert got[6].listing_id is None and got[6].errors == ["NO_PRICE"]
