"""A local session and the small catalogue used by the tests."""

from __future__ import annotations

import os
from datetime import datetime

import pytest
from pyspark.sql import SparkSession

def _product(key: str, title: str, category: str, **attributes: str) -> str:
    listed = ";".join(f"{name.replace('_', ' ')}:{value}" for name, value in attributes.items())
    return f'{key};{title};{category};"{listed}"\n'


def _purchase(number: int, key: str, title: str, day: str, cost: int, buyer: str, town: str = "Омск") -> str:
    return f"{title};D-{number};{key};{day} 08:00:00;{cost};{buyer};Покупатель {buyer};{town};77{number};Склад {number % 3};Пермь\n"


TITLES = {
    "K10": "Конфеты шоколадные Северянка 500 г", "T61": "Шина летняя Nordex Road 195 R15", "M27": "Монитор Dell P2723 27 дюйм",
    "K12": "Конфеты желейные Радуга 250 г", "T58": "Шина зимняя Nordex Ice 205 R16", "W90": "Планшет Lenovo Tab M10",
    "T63": "Шина всесезонная Kama 185 R14",
}
#: Seven goods: three tyres, two boxes of sweets, a screen, a tablet; one to four attributes each.
PRODUCTS = "\ufeff" + "".join([
    _product("K10", TITLES["K10"], "Сладости", Вес="500 г", Начинка="орех", Упаковка="коробка", Цвет="красный"),
    _product("T61", TITLES["T61"], "Шины", Сезон="лето", Ширина="195 мм"),
    _product("M27", TITLES["M27"], "Мониторы", Диагональ="27 дюйм", Матрица="IPS", Цвет="чёрный"),
    _product("K12", TITLES["K12"], "Сладости", Вес="250 г"),
    _product("T58", TITLES["T58"], "Шины", Сезон="зима", Ширина="205 мм"),
    _product("W90", TITLES["W90"], "Планшеты", Экран="10 дюйм", Цвет="белый"),
    _product("T63", TITLES["T63"], "Шины", Сезон="любой"),
])
#: 31 buys sweets again and again, 40 tyres and a screen, 52 only what is not in the catalogue, 67 on a day to come.
CONTRACTS = "".join([
    _purchase(901, "T58", TITLES["T58"], "2024-10-30", 7200, "40"),
    _purchase(902, "K10", TITLES["K10"], "2025-05-20", 640, "31"),
    _purchase(903, "Z00", "Снятый товар", "2025-01-09", 15, "52", "Тверь"),
    _purchase(904, "K10", TITLES["K10"], "2025-03-02", 320, "31"),
    _purchase(905, "M27", TITLES["M27"], "2025-04-11", 21500, "40"),
    _purchase(906, "K12", TITLES["K12"], "2024-12-28", 180, "31"),
    _purchase(907, "T63", TITLES["T63"], "2031-02-01", 5100, "67"),
    _purchase(908, "T61", TITLES["T61"], "2025-04-12", 6900, "40"),
])
RUN_AT = datetime(2025, 6, 1)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def write_file(folder, name: str, content: str) -> str:
    path = os.path.join(str(folder), name)
    with open(path, "w", encoding="utf-8") as handle:
        handle.write(content)
    return path


@pytest.fixture(scope="session")
def snapshot(spark, tmp_path_factory):
    """Folder of the tables after a full load of the small catalogue, and its run-log row."""
    from quarry.sources import store

    folder = tmp_path_factory.mktemp("full")
    target = str(folder / "tables")
    run = store.refresh(
        spark, target, "replace_all", RUN_AT,
        products_path=write_file(folder, "products.csv", PRODUCTS),
        contracts_path=write_file(folder, "contracts.csv", CONTRACTS),
    )
    return target, run.first()


@pytest.fixture(scope="session")
def tables(spark, snapshot):
    from quarry.plans.search import load_search_tables

    return load_search_tables(spark, snapshot[0])


@pytest.fixture(scope="session")
def overlay(spark, snapshot):
    from quarry.operators.scoring import Overlay
    from quarry.sources.store import read_table

    folder = snapshot[0]
    return Overlay(
        read_table(spark, folder, "product_weights"),
        read_table(spark, folder, "category_weights"),
        read_table(spark, folder, "profiles"),
    )
