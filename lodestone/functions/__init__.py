from lodestone.functions.exact import exact_avg, exact_sum

__all__ = ["exact_avg", "exact_sum"]
