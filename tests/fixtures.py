"""Hand-built staging tables in the native schema, one trap per row group.

Expected values used by the tests are derived by hand in the comments.
"""

from datetime import datetime as T
from decimal import Decimal as D

from bazaar.sources.schemas import STAGING_SCHEMAS
from bazaar.sources.staging import staging_from_frames

CUSTOMERS = [
    ("c1", "U1", "01000", "sao paulo", "SP"),
    ("c2", "U1", "01001", "sao paulo", "SP"),   # same person, second customer id
    ("c3", "U3", "20000", "rio", "RJ"),
    ("c4", "U4", "30000", "bh", "MG"),
    ("c5", "U5", "20001", "rio", "RJ"),
]

ORDERS = [
    # approved < purchase and delivered < carrier: two flags TRUE
    ("o1", "c1", "delivered", T(2020, 1, 31, 10), T(2020, 1, 31, 9), T(2020, 2, 2), T(2020, 2, 1), T(2020, 2, 10)),
    # NULL approved / carrier: flags FALSE; estimated < purchase: TRUE
    ("o2", "c2", "delivered", T(2020, 2, 29, 9), None, None, T(2020, 3, 5), T(2020, 2, 20)),
    ("o3", "c3", "delivered", T(2020, 1, 10, 23), T(2020, 1, 11), T(2020, 1, 12), T(2020, 1, 15), T(2020, 1, 20)),
    ("o4", "c3", "delivered", T(2020, 3, 10, 1), T(2020, 3, 10, 2), T(2020, 3, 11), T(2020, 3, 12), T(2020, 3, 20)),
    ("o5", "c4", "shipped", T(2020, 2, 15), T(2020, 2, 15, 1), T(2020, 2, 16), None, T(2020, 2, 25)),
    # delivered, no lines, latest purchase of all: sets the RFM reference date
    ("o6", "c5", "delivered", T(2021, 3, 1, 12), T(2021, 3, 1, 13), T(2021, 3, 2), T(2021, 3, 3), T(2021, 3, 9)),
    ("o7", "c5", "delivered", T(2020, 1, 5), T(2020, 1, 5, 1), T(2020, 1, 6), T(2020, 1, 7), T(2020, 1, 15)),
    ("o8", "c5", "delivered", T(2021, 2, 5), T(2021, 2, 5, 1), T(2021, 2, 6), T(2021, 2, 7), T(2021, 2, 15)),
    # unknown customer: orphan, dropped from fact_orders
    ("o9", "c9", "delivered", T(2020, 5, 1), T(2020, 5, 1, 1), T(2020, 5, 2), T(2020, 5, 3), T(2020, 5, 9)),
]

ITEMS = [
    ("o1", 1, "p1", "s1", T(2020, 2, 1), D("10.125"), D("1.00")),   # 10.125 -> 10.13 (half up)
    ("o1", 2, "pX", "s1", T(2020, 2, 1), D("7.00"), D("0.70")),     # unknown product: dropped
    ("o2", 1, "p2", "s2", T(2020, 3, 1), D("20.00"), D("2.00")),
    ("o3", 1, "p1", "s1", T(2020, 1, 12), D("30.00"), D("0.00")),
    ("o3", 2, "p3", "s3", T(2020, 1, 12), D("5.00"), D("0.50")),
    ("o4", 1, "p2", "s2", T(2020, 3, 11), D("40.00"), D("4.00")),
    ("o5", 1, "p1", "s1", T(2020, 2, 16), D("50.00"), D("5.00")),
    ("o7", 1, "p4", "s4", T(2020, 1, 6), D("15.00"), D("1.50")),
    ("o8", 1, "p4", "s4", T(2021, 2, 6), D("25.00"), D("2.50")),
]

SELLERS = [("s1", "01000", "sao paulo", "SP"), ("s2", "20000", "rio", "RJ"),
           ("s3", "30000", "bh", "MG"), ("s4", "01002", "sao paulo", "SP")]

PRODUCTS = [
    ("p1", "A", 10, 100, 1, 500, 10, 10, 10),      # translated
    ("p2", "B", 11, 110, 2, 600, 11, 11, 11),      # no translation row: unmapped
    ("p3", None, 12, 120, 3, 700, 12, 12, 12),     # NULL category: 'unknown', not unmapped
    ("p4", "C", 13, 130, 4, 800, 13, 13, 13),      # translation row with NULL English name
]

TRANSLATION = [("A", "a_en"), ("C", None), ("D", "d_en")]

PAYMENTS = [("o1", 1, "credit_card", 1, D("11.13")), ("o2", 1, "voucher", 1, D("22.00")),
            ("o2", 2, "voucher", 1, D("-1.00"))]

REVIEWS = [
    ("r1", "o1", 4, None, None, T(2020, 2, 5), T(2020, 2, 6)),
    ("r2", "o1", 5, None, None, T(2020, 2, 5), T(2020, 2, 7)),     # same creation, later answer: kept
    ("r3", "o2", 1, None, None, None, T(2020, 3, 10)),             # NULL creation sorts last
    ("r4", "o2", 2, "t", "multi\nline", T(2020, 3, 8), None),      # kept
    ("r5", "o3", 3, None, None, T(2020, 1, 15), T(2020, 1, 16)),
    ("r6", "o3", 3, None, None, T(2020, 1, 15), T(2020, 1, 16)),   # full tie: higher review_id kept
]

GEO = [("01000", D("-23.5"), D("-46.6"), "sao paulo", "SP")]

TABLES = {
    "orders": ORDERS, "customers": CUSTOMERS, "order_items": ITEMS, "sellers": SELLERS,
    "products": PRODUCTS, "order_payments": PAYMENTS, "order_reviews": REVIEWS, "geolocation": GEO,
    "product_category_name_translation": TRANSLATION,
}


def frames(spark, tables=None):
    tables = tables or TABLES
    return {n: spark.createDataFrame(rows, STAGING_SCHEMAS[n]) for n, rows in tables.items()}


def golden_staging(spark, tables=None):
    return staging_from_frames(frames(spark, tables))


def dirty_tables():
    """Key violations for the staging checks (never fed to core builds)."""
    t = {k: list(v) for k, v in TABLES.items()}
    t["orders"].append(ORDERS[0])                                     # duplicate order_id
    t["orders"].append((None,) + ORDERS[1][1:])                       # NULL order_id
    t["customers"].append(CUSTOMERS[0])                                # duplicate customer_id
    t["customers"].append((None, "U9", "1", "x", "SP"))                # NULL customer_id
    t["sellers"] += [SELLERS[0], (None, "1", "x", "SP")]
    t["products"] += [PRODUCTS[0], (None,) + PRODUCTS[0][1:]]
    t["order_items"] += [ITEMS[0], ("o2", 2, None, "s2", None, D("-1.00"), D("-0.50"))]
    return t


def unknown_time_tables():
    """The golden tables with delivered orders of unknown purchase time, of a new and of a known person."""
    t = {k: list(v) for k, v in TABLES.items()}
    t["orders"] += [("oN1", "c4", "delivered", None, None, None, None, None), ("oN2", "c3", "delivered", None, None, None, None, None)]
    t["order_items"] += [("oN1", 1, "p1", "s1", None, D("3.00"), D("0.30")), ("oN2", 1, "p2", "s2", None, D("4.00"), D("0.40"))]
    return t


def skewed_tables(seed: int = 11):
    """A generated staging set with hot keys, heavy ties and every trap class.

    * customer c007 places a third of all orders; persons own two customer ids;
    * order o00001 holds a third of all order lines; product p001 a third of lines;
    * frequencies tie massively (most persons order once or twice);
    * prices carry three decimals (half-up rounding), some amounts are negative;
    * orphans: orders of unknown customers, lines of unknown products/sellers;
    * delivered orders without lines; NULL timestamps; month-end purchase times.
    """
    import random
    from datetime import timedelta

    rnd = random.Random(seed)
    states = ["SP", "RJ", "MG", "RS", "BA"]
    customers = [(f"c{i:03d}", f"U{i // 2:03d}", f"{rnd.randint(1000, 99999):05d}", f"city{i % 17}",
                  rnd.choice(states)) for i in range(200)]
    cats = ["cat_a", "cat_b", "cat_c", "cat_d", "cat_e", "cat_f", "cat_g", None]
    products = [(f"p{i:03d}", cats[i % len(cats)], rnd.randint(5, 60), rnd.randint(50, 900), rnd.randint(1, 6),
                 rnd.randint(100, 5000), rnd.randint(5, 50), rnd.randint(5, 50), rnd.randint(5, 50))
                for i in range(50)]
    translation = [("cat_a", "A"), ("cat_b", "B"), ("cat_c", "C"), ("cat_d", None), ("cat_e", "E"), ("cat_z", "Z")]
    sellers = [(f"s{i:02d}", f"{rnd.randint(1000, 99999):05d}", f"city{i % 5}", rnd.choice(states))
               for i in range(30)]

    base = T(2019, 1, 1)
    orders = []
    for i in range(1200):
        cust = "c007" if i % 3 == 0 else (f"c9{i:02d}" if i % 97 == 5 else f"c{rnd.randint(0, 199):03d}")
        status = rnd.choices(["delivered", "shipped", "canceled"], [8, 1, 1])[0]
        if i % 50 == 0:   # month-end purchases at various times of day
            purchase = T(2020, rnd.choice([1, 3, 5, 7]), 31, rnd.randint(0, 23), rnd.randint(0, 59))
        else:
            purchase = base + timedelta(days=rnd.randint(0, 1094), seconds=rnd.randint(0, 86399))
        if i % 113 == 7:   # unknown purchase time
            orders.append((f"o{i:05d}", cust, status, None, None, None, None, None))
            continue
        approved = None if i % 41 == 0 else purchase + timedelta(hours=rnd.randint(-3, 30))
        carrier = None if i % 37 == 0 else purchase + timedelta(days=rnd.randint(1, 4))
        delivered = (purchase + timedelta(days=rnd.randint(0, 20))) if status == "delivered" else None
        estimated = purchase + timedelta(days=rnd.randint(-2, 30))
        orders.append((f"o{i:05d}", cust, status, purchase, approved, carrier, delivered, estimated))

    items = []
    for n in range(1000):   # the hot order
        items.append(("o00001", n + 1, rnd.choice(["p001", f"p{rnd.randint(0, 49):03d}"]),
                      f"s{rnd.randint(0, 29):02d}", base, D(f"{rnd.randint(100, 99999)}.{rnd.randint(0, 999):03d}") / 100,
                      D(rnd.randint(0, 3000)) / 100))
    for i in range(2, 1200):
        for n in range(rnd.choice([0, 1, 1, 1, 2, 3])):
            prod = "p001" if rnd.random() < 0.33 else (f"pX{i}" if i % 211 == 0 else f"p{rnd.randint(0, 49):03d}")
            sell = f"sX{i}" if i % 223 == 0 else f"s{rnd.randint(0, 29):02d}"
            price = D(f"{rnd.randint(1, 2000)}.{rnd.randint(0, 999):03d}")
            freight = D(rnd.randint(-100, 3000)) / 100 if i % 151 == 0 else D(rnd.randint(0, 3000)) / 100
            items.append((f"o{i:05d}", n + 1, prod, sell, base + timedelta(days=i), price, freight))

    payments = []
    for i in range(1200):
        payments.append((f"o{i:05d}", 1, rnd.choice(["credit_card", "boleto", "voucher"]), rnd.randint(1, 10),
                         D(rnd.randint(-500, 90000)) / 100))
        if i % 4 == 0:
            payments.append((f"o{i:05d}", 2, "voucher", 1, D("10.00")))

    reviews = []
    for j in range(1500):
        o = f"o{rnd.randint(0, 1199):05d}"
        created = None if j % 29 == 0 else T(2020, rnd.randint(1, 12), rnd.randint(1, 28))
        answered = None if j % 31 == 0 else T(2020, rnd.randint(1, 12), rnd.randint(1, 28), rnd.randint(0, 23))
        reviews.append((f"r{j:05d}", o, rnd.randint(1, 5), None, None, created, answered))
    reviews.append(("r99999", reviews[0][1], 1, None, None, reviews[0][5], reviews[0][6]))   # exact tie

    return {
        "orders": orders, "customers": customers, "order_items": items, "sellers": sellers,
        "products": products, "order_payments": payments, "order_reviews": reviews,
        "geolocation": GEO, "product_category_name_translation": translation,
    }
