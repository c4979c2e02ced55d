from loofold.functions import metrics, scalars

__all__ = ["metrics", "scalars"]
