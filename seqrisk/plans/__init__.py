"""Physical-plan building blocks shared by the operators: ordering, joins, materialisation."""
