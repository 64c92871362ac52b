"""Training-data operators: quality, licences, packing, token counts,
decontamination, near and exact duplicate removal, toxicity, vector search
and personal data.  Nothing else in the library imports this subpackage."""
