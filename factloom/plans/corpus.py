"""Source files made from rows, so that parsers and resolvers have as many files as the tables have rows.

Every part is a Python module, with a test module and a manifest; every supplier is a client script, a schema and a page.
What the operators must find in them follows from the rows, which is how the queries' SQL states it.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract as E
from ..operators import resolve as R
from ..sources.tables import settle, table

#: Of part k with the part before it as b, its size as s, and a topic for every four parts as t.
MODULE = """import os
from shop.base import Base
from shop.part_{b} import step_{b} as other
router_{k} = APIRouter()
class Part{k}(Base):
    __tablename__ = 'part_{k}'
    id = Column(Integer, primary_key=True)
    owner = Column(Integer, ForeignKey('part_{b}.id'), nullable=False)
    def price(self, n):
        return self.tax(n)
    def tax(self, n):
        return n
def step_{k}(db, n):
    '''Step of part {k}.'''
    key = os.getenv('KEY_{s}')
    db.execute('INSERT INTO stock_{k} (id) VALUES ({s})')
    producer.send('topic_{t}', n)
    return other(db, n)
@router_{k}.get('/parts/{{id}}/{k}')
def read_{k}(n: Order{k}, db=Depends(step_{k})) -> Price{s}:
    return step_{k}(None, n)
@consumer('topic_{t}')
@on_event('job_{k}')
def on_{k}(m):
    if m:
        key = Part{k}()
    table = {{'a': step_{k}, 'b': read_{k}}}
    table['a'](m)
    return render('page_{s}.html', m)
class Order{k}(BaseModel):
    sku: str
    n: Optional[int] = Field(None, max_length={s})
app.include_router(router_{k}, prefix='/p{s}')
"""
TEST = """import pytest
from shop.part_{k} import step_{k}
def test_step_{k}():
    assert step_{k}(None, 1)
"""
BASE = "class Base:\n    pass\n"
#: Of supplier k of nation n.
SCRIPT = """import {{ api }} from '@shop/nation-{n}'
export class Cart{k} extends Base {{
  total() {{ return sum(this.items) }}
}}
export const load_{k} = async (id) => {{
  return fetch('/api/v1/p{n}/parts/1/{k}', {{ method: '{m}' }})
}}
"""
SCHEMA = """CREATE TABLE supply_{k} (id int primary key, name text not null, nation int references nation_{n}(id));
SELECT id FROM supply_{k};
DELETE FROM supply_{n};
"""
PAGE = "{{% extends 'base_{n}.html' %}}\n<script src='/js/{k}.js'></script>\n<form action='/go/{n}'></form>\n"


def filled(template: str, **columns: Column) -> Column:
    """The template with columns in place of {name}; doubled braces stand for themselves."""
    parts, at = [], 0
    for m in re.finditer(r"\{\{|\}\}|\{(\w+)\}", template):
        parts += [F.lit(template[at : m.start()]), columns[m[1]].cast("string") if m[1] else F.lit(m[0][0])]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text, language. Rows are dealt out by key: a small file of rows is one task, and makes many texts to parse."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    p = table(spark, sf_dir, "part", "p_partkey", "p_size").repartition(n, "p_partkey").select(F.col("p_partkey").alias("k"), F.greatest(F.col("p_partkey") - 1, F.lit(0)).alias("b"), F.col("p_size").alias("s"), F.floor(F.col("p_partkey") / 4).alias("t"))
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").repartition(n, "s_suppkey").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"), F.when(F.col("s_nationkey") % 3 == 0, "POST").otherwise("GET").alias("m"))
    one = lambda df, path, text, language: df.select(filled(path, **{c: F.col(c) for c in df.columns}).alias("path"), filled(text, **{c: F.col(c) for c in df.columns}).alias("text"), F.lit(language).alias("language"))
    parts = [
        one(p, "shop/part_{k}.py", MODULE, "python"), one(p, "tests/test_part_{k}.py", TEST, "python"), spark.createDataFrame([("shop/base.py", BASE, "python")], "path string, text string, language string"),
        one(s, "web/cart_{k}.ts", SCRIPT, "typescript"), one(s, "db/supply_{k}.sql", SCHEMA, "sql"), one(s, "web/page_{k}.html", PAGE, "html"),
    ]
    return reduce(DataFrame.unionByName, parts)


def facts(spark: SparkSession, sf_dir: str, *kinds: str) -> list[DataFrame]:
    """Fact tables of the kinds named; the files are parsed once."""
    every = settle(E.parse(files(spark, sf_dir), kinds))
    return [E.fact(every, k) for k in kinds]


KINDS = tuple(R.facts_for(()))


def edges(spark: SparkSession, sf_dir: str, *kinds: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Edges of all files, all or only of the relationships named, and the facts that they come from."""
    names = R.facts_for(kinds)
    found = dict(zip(names, facts(spark, sf_dir, *names)))
    return settle(R.all_edges(files(spark, sf_dir), found, kinds)), found
