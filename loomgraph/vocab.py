"""IRIs in the key form of terms (``<iri>``)."""

RDF, RDFS, OWL, XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2001/XMLSchema#"
PREFIXES = {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD}


def rdf(name: str) -> str:
    return f"<{RDF}{name}>"


def rdfs(name: str) -> str:
    return f"<{RDFS}{name}>"


def owl(name: str) -> str:
    return f"<{OWL}{name}>"


TYPE, FIRST, REST, NIL = rdf("type"), rdf("first"), rdf("rest"), rdf("nil")
SUBCLASS, SUBPROPERTY, DOMAIN, RANGE, LABEL = rdfs("subClassOf"), rdfs("subPropertyOf"), rdfs("domain"), rdfs("range"), rdfs("label")
SAME, DIFFERENT, INVERSE, EQUIVALENT, DISJOINT = owl("sameAs"), owl("differentFrom"), owl("inverseOf"), owl("equivalentClass"), owl("disjointWith")
INTERSECTION, UNION, CHAIN, KEY = owl("intersectionOf"), owl("unionOf"), owl("propertyChainAxiom"), owl("hasKey")
ON_PROPERTY, SOME_VALUES, ALL_VALUES = owl("onProperty"), owl("someValuesFrom"), owl("allValuesFrom")
TRANSITIVE, IRREFLEXIVE, ASYMMETRIC = owl("TransitiveProperty"), owl("IrreflexiveProperty"), owl("AsymmetricProperty")
CLASS, OBJECT_PROPERTY, DATA_PROPERTY, ANNOTATION_PROPERTY, INDIVIDUAL = owl("Class"), owl("ObjectProperty"), owl("DatatypeProperty"), owl("AnnotationProperty"), owl("NamedIndividual")
THING, NOTHING, IMPORTS, ONTOLOGY = owl("Thing"), owl("Nothing"), owl("imports"), owl("Ontology")

# Types that mark schema entities rather than individuals.
META = [
    CLASS, rdfs("Class"), OBJECT_PROPERTY, DATA_PROPERTY, ANNOTATION_PROPERTY, rdf("Property"), ONTOLOGY, owl("Restriction"), rdfs("Datatype"),
    owl("FunctionalProperty"), owl("InverseFunctionalProperty"), owl("SymmetricProperty"), TRANSITIVE,
]
