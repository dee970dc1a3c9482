"""Registered queries over the given tables, each with its oracle where SQL can
express it. Importing this package fills ``raceflow.registry.ENTRIES``."""

import importlib
import pkgutil

for _module in pkgutil.iter_modules(__path__):
    importlib.import_module(f"{__name__}.{_module.name}")
