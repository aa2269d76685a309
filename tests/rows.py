"""Invented rows with the traps the pipelines must handle, shared by the tests.

Products: padded and inner white space, a quote, a missing price, four date forms, a row twice.
Customers: of the second round, one is gone, two moved, one changed segment and e-mail, one is new.
"""

PRODUCTS_1 = [
    ("K-07", "Garden  Chair XL", "Outdoor", "412.50", "2026-01-01"),
    ("K-08", ' Lamp 5" ', "outdoor", "18.75", "01.02.2026"),
    ("K-09", "Folding Table", "Outdoor", None, "03/01/2026"),
    ("M-01", "Sheet Music", "Paper", "7.20", "2026-01-15"),
    ("M-02", "  Notebook", " Paper ", "3.10", "20260201"),
    ("M-02", "  Notebook", " Paper ", "3.10", "20260201"),
]
PRODUCTS_2 = [("K-07", "Garden Chair XL", "Outdoor", "398.00", "2026-10-01"), ("T-55", "Kettle", "Kitchen", "64.00", "08.10.2026")]


def customers(name="Client {}", email="mail{}@post.test"):
    first = [(i, name.format(i), email.format(i), "Oslo", "Private") for i in range(1, 21)]
    moved = {4: "Bergen", 9: "Bergen"}
    second = [(i, n, e, moved.get(i, c), s) for i, n, e, c, s in first if i not in (13, 16)]
    second += [(16, name.format(16), "office16@post.test", "Oslo", "Company"), (33, "Ida   Holm", "IDA.HOLM@POST.TEST", "Tromso", "Public")]
    return first, second
