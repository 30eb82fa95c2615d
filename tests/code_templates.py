"""Source templates of the generated code corpus.

``code_files`` is derived from ``documents.doc_id``: file ``i`` takes template
``i % 10`` with ``{i}`` replaced by the doc id and ``{j}`` by a neighbour in the
same package of ten.  Each template carries one positive and one negative case
for a family of rules; template 9 is template 0 with a few lines changed.

The texts are plain data: the Spark side and the DuckDB oracle both substitute
them with the same string expressions.
"""

from __future__ import annotations

_T0 = '''"""Plain helpers for module {i}."""
import json
from m{j} import helper_{j}


def helper_{i}(value: int, scale: int = 2) -> int:
    """Scale a value.

    Args:
        value: the input number
        scale: the factor

    Returns:
        the scaled value
    """
    result = value * scale
    return result


def describe_{i}(name: str, count: int) -> str:
    """Describe a name together with a count."""
    total = helper_{j}(count)
    payload = json.dumps({"name": name, "total": total})
    return payload


def merge_{i}(first: list, second: list) -> list:
    """Merge two lists without repeats."""
    merged = list(first)
    for item in second:
        if item not in merged:
            merged.append(item)
    return merged
'''

_T1 = '''"""Risky calls for module {i}."""
import os
import subprocess
from m{j} import helper_{j}


def run_task_{i}(request, cmd):
    message = "bad input %s" % cmd
    os.system(cmd)
    subprocess.run(f"ls {cmd}", shell=True)
    return helper_{j}(1)


def list_dir_{i}(folder):
    subprocess.run(["ls", "-l"], check=True)
    return folder


def find_user_{i}(cursor, user_input):
    query = "SELECT * FROM users WHERE name = '%s'" % user_input
    cursor.execute(query)
    cursor.execute("SELECT * FROM users WHERE id = %s", (user_input,))
    return cursor.fetchall()


def render_{i}(request):
    name = request.args.get("name")
    html = "<div>" + request.args.get("title") + "</div>"
    return html + name


def evaluate_{i}(expr):
    return eval(expr)


def load_{i}(user_path):
    path = os.path.join("/data", user_path)
    handle = open(path)
    return handle.read()
'''

_T2 = '''"""Deep nesting for module {i}."""
from m{j} import helper_{j}


def classify_{i}(items, limit):
    count = 0
    for item in items:
        if item > 0:
            if item < limit:
                while count < limit:
                    if count % 2 == 0:
                        count += 1
                    else:
                        count += 2
    return count


def route_{i}(code):
    if code == 1:
        return "one"
    elif code == 2:
        return "two"
    elif code == 3:
        return "three"
    elif code == 4:
        return "four"
    else:
        return "many"


def decide_{i}(a, b, c, d):
    values = [x * 2 for x in a if x > 0]
    if a and b:
        for x in values:
            if x > 1 or c:
                with open("log.txt") as fh:
                    if d:
                        try:
                            fh.write("deep")
                        except ValueError:
                            pass
    while b and c:
        b = b - 1
    return helper_{j}(len(values))
'''

_T3_HEAD = '''"""Wide functions for module {i}."""
from m{j} import helper_{j}


def configure_{i}(host, port, user, password, timeout, retries):
    settings = {}
    settings["host"] = host
    settings["port"] = port
    settings["user"] = user
    settings["password"] = password
    settings["timeout"] = timeout * 60
    settings["retries"] = retries + 3
    return settings


def build_{i}(a, b, c, d, e, f, g, list):
    x = a + b
    y = c * 42
    z = d - 7.5
    w = e / 3600
    v = f + 255
    u = g * 1000
    total = x + y + z + w + v + u
'''
# A long body is written by rule: 48 running-sum steps.
_T3_BODY = "".join(f"    total = total + step_{k:02d}(total)\n" for k in range(1, 49))
_T3 = _T3_HEAD + _T3_BODY + '''    return helper_{j}(total)


def short_{i}(value):
    """Return the value."""
    return value
'''

_T4 = '''"""Exception handling for module {i}."""
import logging
from typing import Optional
from m{j} import helper_{j}


def read_config_{i}(path):
    try:
        handle = open(path)
        data = handle.read()
    except:
        data = ""
    return data


def read_safe_{i}(path):
    with open(path) as handle:
        return handle.read()


def parse_{i}(text):
    try:
        value = int(text)
    except Exception as exc:
        logging.error("bad input %s", exc)
        raise ValueError("not a number")
    else:
        value = value + helper_{j}(1)
    finally:
        logging.info("parsed")
    return value


def check_{i}(flag):
    if flag:
        return True
        logging.info("never")
    return False


def convert_{i}(text) -> int:
    if text:
        print(text)


def finish_{i}(value):
    return value
    print(value)


def pick_{i}(value: Optional[int], items):
    total = value + 1
    if value is None:
        return items
    return total
'''

_T5 = '''"""Classes for module {i}."""


class BaseStore:
    """Base storage."""

    def save(self, item):
        raise NotImplementedError


class Store(BaseStore):
    """Keeps items."""

    _instance = None

    def __new__(cls):
        if cls._instance is None:
            cls._instance = super().__new__(cls)
        return cls._instance

    def save(self, item):
        self.items.append(item)

    def get_instance(self):
        return self._instance


class Order:
    """An order placed in a store."""

    def __init__(self, store: Store, amount: int):
        self.store = store
        self.amount = amount
        assert self.amount >= 0

    def total(self, rate: float) -> float:
        return Store.rate + Store.fee + Store.tax + self.amount

    def archive(self) -> Store:
        Store.save(self)
        return self.store

    def apply(self, rate):
        self.amount = self.amount * rate


class ReportFactory:
    """Builds reports."""

    def create_report(self, kind):
        return Order(None, 0)


class SortStrategy:
    def execute(self, data):
        raise NotImplementedError

    def describe(self):
        pass


class Manager:
    def open_account(self):
        return 1

    def close_account(self):
        return 2

    def deposit(self, amount):
        return amount

    def withdraw(self, amount):
        return amount

    def balance(self):
        return 0

    def history(self):
        return []

    def notify(self):
        return None

    def audit(self):
        return None

    def export(self):
        return None

    def restore(self):
        return None

    def freeze(self):
        return None

    def unfreeze(self):
        return None


class Basket:
    def __len__(self):
        return 0

    def __contains__(self, item):
        return False
'''

_T6 = '''"""Contracts for module {i}."""


def divide_{i}(num, den):
    """Divide two numbers.

    Args:
        num: the numerator
        den: the denominator

    Returns:
        the quotient

    Raises:
        ZeroDivisionError: when den is zero
        KeyError: never raised here

    Preconditions:
        den is not zero

    Postconditions:
        result times den equals num
    """
    assert den != 0
    if den is None:
        raise TypeError("den is None")
    result = num / den
    assert result is not None
    return result


def scale_{i}(value, factor):
    """Scale a value.

    :precondition: factor > 0
    :postcondition: result >= value
    :raises: ValueError
    """
    if factor <= 0:
        raise ValueError("factor must be positive")
    return value * factor


def mix_{i}(a, b, c):
    if a > b:
        a = a - 1
    if b > c:
        b = b - 1
    if c > a:
        c = c - 1
    if a == c:
        raise RuntimeError("equal")
    return a + b + c
'''

_T7 = '''"""Loops for module {i}."""
from m{j} import helper_{j}


def pairs_{i}(items, db):
    out = []
    for a in items:
        for b in items:
            out.insert(0, (a, b))
    for item in items:
        row = db.query(item)
        out.append(row[item])
    return out


def join_{i}(words, extra=[]):
    text = ""
    for word in words:
        text += word
    return text


def countdown_{i}(n):
    while n > 0:
        n = n - 1
    total = 0
    for k in range(n):
        total *= 2
    ratio = total / n
    return helper_{j}(ratio)


def sign_{i}(value, items):
    if value > 0:
        return items[:3]
    else:
        value = -value
    return value
'''

_T8 = '''"""Imports for module {i}."""
import os
import sys
import numpy as np
from collections import *
from typing import Callable
from m{j} import helper_{j}, unused_{j}
import json as js


def paths_{i}(base):
    return os.path.join(base, "x")


def timed_{i}(func: Callable):
    def wrapper(*args):
        return func(*args)
    return wrapper


def arguments_{i}():
    return np.array(sys.argv)
'''

_T9 = '''"""Plain helpers for module {i}."""
import json
from m{j} import helper_{j}


def helper_{i}(value: int, scale: int = 2) -> int:
    """Scale a value.

    Args:
        value: the input number
        scale: the factor

    Returns:
        the scaled value
    """
    result = value * scale
    return result


def describe_{i}(name: str, count: int) -> str:
    """Describe a name together with a count."""
    total = helper_{j}(count) + 1
    payload = json.dumps({"name": name, "total": total})
    return payload


def describe_again_{i}(name: str, count: int) -> str:
    """Describe a name together with a count."""
    total = helper_{j}(count) + 2
    payload = json.dumps({"name": name, "total": total})
    return payload


def merge_{i}(first: list, second: list) -> list:
\tmerged = set(first)
\tfor item in second:
\t\tmerged.add(item)
\treturn sorted(merged)


NOTE = """
This module keeps a note.

It spans several lines.
"""
'''

# The ten templates in order 0..9.
TEMPLATES: list[str] = [_T0, _T1, _T2, _T3, _T4, _T5, _T6, _T7, _T8, _T9]


def write_code_files(documents, folder):
    """A small table of source files, ten to a package: one template per document id, with its id and a neighbour's filled in."""
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = []
    for i in documents:
        text = TEMPLATES[i % 10].replace("{i}", str(i)).replace("{j}", str(i // 10 * 10 + (i * 7 + 3) % 10))
        rows.append({"file_id": i, "path": f"pkg{i // 10}/m{i}.py", "content": text})
    os.makedirs(f"{folder}/code_files.parquet")
    pq.write_table(pa.Table.from_pylist(rows), f"{folder}/code_files.parquet/part-0.parquet")
