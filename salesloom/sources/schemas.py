"""Schemas of the retail tables as they are exported to CSV.

Fixed values: table and column names and their order in the export.
"""

from __future__ import annotations

CATEGORIES = "CategoryID bigint, CategoryName string, Description string"
PRODUCTS = (
    "ProductID bigint, ProductName string, SupplierID bigint, CategoryID bigint, QuantityPerUnit string, "
    "UnitPrice decimal(19,4), UnitsInStock int, UnitsOnOrder int, ReorderLevel int, Discontinued int"
)
SUPPLIERS = (
    "SupplierID bigint, CompanyName string, ContactName string, ContactTitle string, Address string, "
    "City string, Region string, PostalCode string, Country string, Phone string, Fax string, "
    "HomePage string"
)
CUSTOMERS = (
    "CustomerID string, CompanyName string, ContactName string, ContactTitle string, "
    "Address string, City string, Region string, PostalCode string, Country string, Phone string, "
    "Fax string"
)
EMPLOYEES = (
    "EmployeeID bigint, LastName string, FirstName string, Title string, TitleOfCourtesy string, "
    "BirthDate timestamp_ntz, HireDate timestamp_ntz, Address string, City string, Region string, "
    "PostalCode string, Country string"
)
EMPLOYEE_TERRITORIES = "EmployeeID bigint, TerritoryID string"
TERRITORIES = "TerritoryID string, TerritoryDescription string, RegionID bigint"
REGION = "RegionID bigint, RegionDescription string"
SHIPPERS = "ShipperID bigint, CompanyName string, Phone string"
ORDERS = (
    "OrderID bigint, CustomerID string, EmployeeID bigint, OrderDate timestamp_ntz, "
    "RequiredDate timestamp_ntz, ShippedDate timestamp_ntz, ShipVia bigint, Freight decimal(19,4)"
)
ORDER_DETAILS = (
    "OrderID bigint, ProductID bigint, UnitPrice decimal(19,4), Quantity int, Discount decimal(5,4)"
)

# table -> (file name, schema)
CSV_TABLES = {
    "categories": ("Category.csv", CATEGORIES),
    "products": ("Products.csv", PRODUCTS),
    "suppliers": ("Suppliers.csv", SUPPLIERS),
    "customers": ("Customers.csv", CUSTOMERS),
    "employees": ("Employees.csv", EMPLOYEES),
    "employee_territories": ("EmployeeTerritories.csv", EMPLOYEE_TERRITORIES),
    "territories": ("Territories.csv", TERRITORIES),
    "region": ("Region.csv", REGION),
    "shippers": ("Shippers.csv", SHIPPERS),
    "orders": ("Orders.csv", ORDERS),
    "order_details": ("Order_Details.csv", ORDER_DETAILS),
}
