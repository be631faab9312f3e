import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from factloom.session import build_session  # noqa: E402

SHOP = os.path.join(ROOT, "tests", "fixtures", "shop")


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", master="local[8]")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def shop_files(spark):
    from factloom.sources.files import read_env_templates, read_tree

    return read_tree(spark, SHOP).unionByName(read_env_templates(spark, SHOP)).cache()


@pytest.fixture(scope="session")
def shop(shop_files):
    from factloom.plans.find_code import Workspace

    return Workspace(shop_files).persist()
