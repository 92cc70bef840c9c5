"""Maps and audits: plans made of operators."""
