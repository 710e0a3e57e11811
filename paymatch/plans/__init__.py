"""Plans of the reference's named steps (C2-C12) and drill-downs.

Each function takes sources (and parameters, and the intermediates it
reads) and returns a lazy DataFrame.
"""
