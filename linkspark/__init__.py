"""linkspark: link-corpus analytics, reversible link codes and dictionary training on PySpark."""
