"""An invented shop in the eleven-table CSV schema, with every edge the reports care about."""

from __future__ import annotations

import datetime as dt
import random
from pathlib import Path

NULL = "NULL"


def _stamp(day: dt.date | None) -> str:
    return NULL if day is None else f"{day.isoformat()} 00:00:00.000"


def _write(folder: Path, name: str, header: list[str], rows: list[tuple]) -> None:
    def cell(value: object) -> str:
        text = NULL if value is None else str(value)
        if any(ch in text for ch in ',"'):
            text = '"' + text.replace('"', '""') + '"'
        return text

    lines = [",".join(header)] + [",".join(map(cell, row)) for row in rows]
    data = "﻿" + "".join(line + "\r\n" for line in lines)
    (folder / name).write_bytes(data.encode("utf-8"))


def write_shop(folder: Path) -> None:
    rnd = random.Random(3)
    _write(
        folder,
        "Category.csv",
        ["CategoryID", "CategoryName", "Description"],
        [(1, "Tools", "Hand, and power"), (2, "Garden", 'Pots, "beds"'), (3, "Paint", None)],
    )
    # id, name, supplier, category, pack, price, stock, on order, level, discontinued
    products = [
        (1, 'Saw 12" fine', 1, 1, "each", "10.00", 0, 0, 5, 0),  # out of stock
        (2, "Hammer, claw", 1, 1, "each", "20.50", 10, 0, 10, 0),  # at the level
        (3, "Rake", 2, 2, "each", "15.25", 15, 0, 10, 0),  # level x 1.5 exactly
        (4, "Spade", 2, 2, "each", "18.00", 14, 0, 10, 0),  # low
        (5, "Pot é", 2, 2, "box", "2.10", 4, 20, 5, 0),  # below, pending
        (6, "Seed", 3, 2, "bag", "1.05", 4, 0, 5, 0),  # below, none on order
        (7, "White", 4, 3, "tin", "30.00", 5, 0, 5, 1),  # supplier 4: all discontinued
        (8, "Black", 4, 3, "tin", "30.00", 50, 0, 0, 1),
        (9, "Never sold", 3, 3, "tin", "9.99", 50, 10, 5, 0),
    ]
    _write(
        folder,
        "Products.csv",
        [
            "ProductID",
            "ProductName",
            "SupplierID",
            "CategoryID",
            "QuantityPerUnit",
            "UnitPrice",
            "UnitsInStock",
            "UnitsOnOrder",
            "ReorderLevel",
            "Discontinued",
        ],
        products,
    )
    suppliers = [
        (1, "Björn & Co", "Norway"),
        (2, "Green, Ltd.", "Chile"),
        (3, "Verde", "Chile"),
        (4, "Lacke AG", "Norway"),
    ]
    _write(
        folder,
        "Suppliers.csv",
        "SupplierID,CompanyName,ContactName,ContactTitle,Address,City,Region,PostalCode,Country,"
        "Phone,Fax,HomePage".split(","),
        [
            (i, n, f"Contact {i}", "Owner", "1, Road", "Town", None, "0123", c, "1", None, None)
            for i, n, c in suppliers
        ],
    )
    customers = [(f"CUS{ch}{ch}", f"Shop {ch}", c) for ch, c in zip("ABCDEFG", "ONNNSSS")]
    countries = {"O": "Oman", "N": "Nepal", "S": "Spain"}
    _write(
        folder,
        "Customers.csv",
        "CustomerID,CompanyName,ContactName,ContactTitle,Address,City,Region,PostalCode,Country,"
        "Phone,Fax".split(","),
        [
            (i, n, "X", "Y", "Z", "City", None if c == "N" else "R", "1", countries[c], "1", None)
            for i, n, c in customers
        ],
    )
    hired = dt.date(2003, 3, 12)
    employees = [
        (1, "Ash", "Ann", "Rep", dt.date(2001, 9, 24)),
        (2, "Birch", "Bo", "Rep", hired),
        (3, "Cedar", "Cy", "Manager", hired),  # hired the same day, same region
        (4, "Dogwood", "Di", "Rep", dt.date(2006, 6, 30)),
    ]
    _write(
        folder,
        "Employees.csv",
        "EmployeeID,LastName,FirstName,Title,TitleOfCourtesy,BirthDate,HireDate,Address,City,"
        "Region,PostalCode,Country".split(","),
        [
            (i, last, first, t, "Mx.", _stamp(dt.date(1960, 1, i)), _stamp(h), "A", "B", None, "C", "D")
            for i, last, first, t, h in employees
        ],
    )
    territories = [("00731", "Northmoor", 1), ("04410", "Lea", 1), ("73055", "Quay", 2), ("00042", "Q", 2)]
    _write(
        folder,
        "Territories.csv",
        ["TerritoryID", "TerritoryDescription", "RegionID"],
        [(i, n.ljust(50), r) for i, n, r in territories],
    )
    _write(
        folder,
        "EmployeeTerritories.csv",
        ["EmployeeID", "TerritoryID"],
        [(2, "00731"), (3, "00731"), (3, "04410"), (1, "73055"), (3, "73055"), (4, "73055")],
    )
    _write(
        folder,
        "Region.csv",
        ["RegionID", "RegionDescription".ljust(50)],
        [(1, "East".ljust(50)), (2, "West".ljust(50)), (3, "Empty".ljust(50))],
    )
    _write(
        folder,
        "Shippers.csv",
        ["ShipperID", "CompanyName", "Phone"],
        [(1, "Fast", "1"), (2, "Slow", "2"), (3, "Idle", "3")],
    )
    # a year and several quarters are missing; customer G never orders, F orders once
    days = [dt.date(1996, 7, 4), dt.date(1996, 8, 9), dt.date(1996, 12, 31), dt.date(1998, 1, 1)]
    orders, lines = [], []
    discounts = ["0", "0.05", "0.0501", "0.10", "0.15", "0.20", "0.25"]
    for n in range(1, 41):
        day = days[n % 4] + dt.timedelta(days=n % 3)
        required = None if n == 5 else day + dt.timedelta(days=28)
        shipped = None if n % 11 == 0 else day + dt.timedelta(days=(n * 7) % 35)
        if n == 28:
            shipped = required
        customer = "CUSFF" if n == 13 else f"CUS{'ABCDE'[n % 5] * 2}"
        orders.append(
            (n, customer, n % 4 + 1, _stamp(day), _stamp(required), _stamp(shipped), n % 2 + 1, f"{n}.25")
        )
        if n == 40:
            continue  # an order without lines
        for product in rnd.sample(range(1, 9), rnd.randint(1, 4)):
            price = "0.00" if n == 17 else products[product - 1][5]  # a zero-revenue order
            lines.append((n, product, price, rnd.randint(1, 20), rnd.choice(discounts)))
    # quantities on the size edges
    for n, quantity in zip((101, 102, 103, 104), (20, 21, 50, 51)):
        day = _stamp(dt.date(1998, 2, 1))
        orders.append((n, "CUSAA", 1, day, day, day, 1, "3.00"))
        lines.append((n, 2, "20.50", quantity, "0"))
    # two customers with equal revenue
    for n, customer in ((105, "CUSBB"), (106, "CUSCC")):
        day = _stamp(dt.date(1998, 3, 1))
        orders.append((n, customer, 2, day, day, None, 2, "3.00"))
    _write(
        folder,
        "Orders.csv",
        "OrderID,CustomerID,EmployeeID,OrderDate,RequiredDate,ShippedDate,ShipVia,Freight".split(","),
        orders,
    )
    _write(
        folder,
        "Order_Details.csv",
        ["OrderID", "ProductID", "UnitPrice", "Quantity", "Discount"],
        lines,
    )
