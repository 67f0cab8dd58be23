from lakecheck.functions import exprs

__all__ = ["exprs"]
